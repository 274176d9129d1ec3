"""Exact global order of any number of rows, without a task that sees them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.scratch import stage

# monotonically_increasing_id() is the task's number, then 33 bits for the row in it.
ROW_BITS = 33


def _in_ranges(rows: DataFrame, order: tuple[Column, ...]) -> DataFrame:
    """Written in order: `_part` numbers the ranges, `_row` the rows of each from 0."""
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    return stage(placed, "ordered").select(
        *rows.columns,
        F.shiftright("_place", ROW_BITS).alias("_part"),
        F.col("_place").bitwiseAND((1 << ROW_BITS) - 1).alias("_row"),
    )


def _with_offsets(ranged: DataFrame, size: Column) -> DataFrame:
    """Add `_offset`, the total size of all ranges before a row's. There are as many ranges as
    shuffle partitions, so the driver adds them up and the table of offsets is broadcast."""
    sizes = sorted(tuple(r) for r in ranged.groupBy("_part").agg(size.cast("bigint")).collect())
    offsets = [0, *accumulate(n for _, n in sizes)]
    table = ranged.sparkSession.createDataFrame(
        [(part, offset) for (part, _), offset in zip(sizes, offsets)], "_part bigint, _offset bigint"
    )
    return ranged.join(F.broadcast(table), "_part")


def add_position(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add each row's place, from 1, in the order of all rows.

    Rows are dealt out by ranges of the order, sorted inside each, and shifted by the sizes of
    the ranges before: they move once. The order should tell most rows apart, since equal ones
    share a range; equal rows come in any order. The input is read twice, so give a written one.
    """
    ranged = _with_offsets(_in_ranges(rows, order), F.count("*"))
    place = F.col("_offset") + F.col("_row") + 1
    return ranged.select(*rows.columns, place.alias(name))


def add_sum_before(rows: DataFrame, weight: str, name: str, *order: Column) -> DataFrame:
    """Add the sum of an integer column over all rows before this one in the order, which
    should be unique. As above, with a running sum inside each range."""
    ranged = _with_offsets(_in_ranges(rows, order), F.sum(weight))
    earlier = (
        Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    )
    inside = F.coalesce(F.sum(weight).over(earlier), F.lit(0))
    return ranged.select(*rows.columns, (F.col("_offset") + inside).alias(name))


def add_average_rank(rows: DataFrame, by: str, name: str, descending: bool = True) -> DataFrame:
    """Add the rank by a column from 1, equal values sharing the mean of their ranks; NULL has
    none. Values are counted first, so a value of any share of the rows is one row to rank. The
    input is read several times, so give a written one."""
    counted = rows.dropna(subset=[by]).groupBy(by).agg(F.count("*").alias("_same"))
    order = F.desc(by) if descending else F.asc(by)
    ranks = add_sum_before(counted, "_same", "_before", order).select(
        by, (F.col("_before") + (F.col("_same") + 1) / 2.0).alias(name)
    )
    return rows.join(ranks, by, "left")
