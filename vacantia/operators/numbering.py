"""Exact positions inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.hashing import whole_quotient

BLOCK = 1 << 16


def number_rows(
    table: DataFrame, group: str, order: str, name: str, block_size: int = BLOCK
) -> DataFrame:
    """Add the 1-based position of each row in its group, by a unique integer column.
    Neither the group nor the order may be NULL.

    A group may hold a large part of all rows, so none is sorted in one task: rows are
    numbered inside blocks of the order column, and a running sum over the block sizes
    (one row per block) shifts each block to its place. Both steps partition by
    (group, block), so the rows move once.
    """
    blocked = table.withColumn("_block", whole_quotient(F.col(order), block_size))
    inside = Window.partitionBy(group, "_block").orderBy(order)
    earlier = (
        Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        blocked.groupBy(group, "_block")
        .agg(F.count("*").alias("_size"))
        .select(group, "_block", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    )
    return (
        blocked.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [group, "_block"])
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_block", "_inside", "_before")
    )
