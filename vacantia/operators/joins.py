"""Equi-joins of a large, possibly skewed side with a table of one row per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.scratch import stage

BROADCAST_BYTES = 64 << 20
# A row costs far more than its text once it is hashed on every executor.
BROADCAST_ROWS = 1 << 20
MIN_SALTS = 16


def is_small(
    lookup: DataFrame, text: str | Column, limit: int = BROADCAST_BYTES, most_rows: int = BROADCAST_ROWS
) -> bool:
    """Whether a lookup table, measured now, has little enough text and few enough rows to
    broadcast."""
    size, rows = lookup.agg(
        F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.count("*")
    ).first()
    return size <= limit and rows <= most_rows


def _salt_count(table: DataFrame) -> int:
    """Grows with the cluster: a key with a third of all rows must not outweigh a task."""
    return max(MIN_SALTS, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)


def salted_lookup(
    large: DataFrame,
    lookup: DataFrame,
    key: str | list[str],
    spread_by: str,
    how: str = "left",
    small: bool = False,
) -> DataFrame:
    """Join on `key`, with the rows of one key spread over many tasks.

    `lookup` holds each key once and is far smaller than `large`, so it is repeated per
    salt. A lookup that was measured to be `small` is broadcast instead. What skew the
    salts leave, adaptive execution splits.
    """
    keys = [key] if isinstance(key, str) else key
    if small:
        return large.join(F.broadcast(lookup), keys, how)
    salts = _salt_count(large)
    spread = large.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")


def staged_lookup(
    large: DataFrame, lookup: DataFrame, key: str | list[str], spread_by: str, how: str
) -> DataFrame:
    """The same for a lookup that is computed from the large side: written once, measured,
    and broadcast if it is small, so that the large side need not move."""
    written = stage(lookup, "lookup")
    text = key if isinstance(key, str) else F.concat(*key)
    return salted_lookup(large, written, key, spread_by, how, is_small(written, text))
