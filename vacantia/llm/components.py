"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.scratch import stage

MAX_ROUNDS = 60


def _signature(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(high, low))")).first())


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links of integers -> (node, component_id), for every node with a link to another.

    component_id is the smallest node of the component. Each round hangs a node's larger
    neighbours on its smallest one, then its smaller neighbours too, until nothing changes;
    the rounds grow with the logarithm of the longest chain. A hub's minimum is combined on the
    map side and written, so that the join back has a plain shuffle on either side and adaptive
    execution splits the hub's rows. Each round is a written table, so a lost executor costs no
    earlier round. Null ends are ignored.
    """
    pairs = (
        links.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
        .distinct()
    )
    pairs = stage(pairs, "links")
    seen = _signature(pairs)
    for _ in range(MAX_ROUNDS):
        both = pairs.select(F.col("low").alias("node"), F.col("high").alias("other")).unionAll(
            pairs.select(F.col("high").alias("node"), F.col("low").alias("other"))
        )
        least = both.groupBy("node").agg(F.min("other").alias("least"))
        least = stage(least.select("node", F.least("node", "least").alias("least")), "least")
        large = stage(
            pairs.join(least, pairs["low"] == least["node"])
            .select("high", F.col("least").alias("low"))
            .distinct(),
            "large",
        )
        lowest = stage(large.groupBy("high").agg(F.min("low").alias("least")), "lowest")
        small = large.join(lowest.withColumnRenamed("high", "node"), F.col("high") == F.col("node"))
        pairs = stage(
            small.select(F.explode(F.array(
                F.struct(F.col("low").alias("high"), F.col("least").alias("low")),
                F.struct("high", F.col("least").alias("low")),
            )).alias("pair"))
            .select("pair.*")
            .where(F.col("high") != F.col("low"))
            .distinct(),
            "links",
        )
        now = _signature(pairs)
        if now == seen:
            return pairs.select(F.col("high").alias("node"), F.col("low").alias("component_id"))
        seen = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
