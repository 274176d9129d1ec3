import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vacantia.operators import effects, ranking


def plan_of(table):
    return table._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def values(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0.5, *(round(rng.gauss(0, 1), 2) for _ in range(3))])) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, value double").repartition(7)


def test_positions_follow_the_order(values):
    placed = ranking.add_position(values, "place", F.desc_nulls_last("value"), F.asc("id")).collect()
    expected = sorted(
        ((r.id, r.value) for r in placed), key=lambda r: (r[1] is None, -(r[1] or 0), r[0])
    )
    assert [(r.id, r.place) for r in sorted(placed, key=lambda r: r.place)] == [
        (id_, place) for place, (id_, _) in enumerate(expected, 1)
    ]


def test_sums_before(spark):
    rows = [(i, i % 4) for i in range(1000)]
    table = spark.createDataFrame(rows, "id long, weight long").repartition(5)
    found = ranking.add_sum_before(table, "weight", "before", F.desc("id")).collect()
    assert {r.id: r.before for r in found} == {i: sum(j % 4 for j in range(i + 1, 1000)) for i in range(1000)}


@pytest.mark.parametrize("descending", [True, False])
def test_average_ranks(values, descending):
    found = ranking.add_average_rank(values, "value", "rank", descending).toPandas().sort_values("id")
    expected = found["value"].rank(ascending=not descending)
    pd.testing.assert_series_equal(found["rank"], expected, check_names=False)


def test_no_rows(spark):
    nothing = spark.createDataFrame([], "value double, weight long")
    assert ranking.add_position(nothing, "place", F.asc("value")).count() == 0
    assert ranking.add_average_rank(nothing, "value", "rank").count() == 0


def test_a_million_effects_of_any_proportion(spark):
    table = spark.range(1_000_000).select(
        F.col("id").cast("string").alias("keyword"),
        F.when(F.col("id") % 3 == 0, 0.25).otherwise(F.col("id") / 1e6).alias("marginal_effect"),
        (F.col("id") % 100 / 100).alias("prop_doc"),
    )
    ranked = effects.effects_rank(table, (0, 1))
    plan = plan_of(ranked)
    assert "SinglePartition" not in plan
    sums = ranked.agg(F.count("rank"), F.sum("rank"), F.count_distinct("marginal_effect")).first()
    assert sums[0] == 1_000_000 and sums[1] == 1_000_000 * 1_000_001 / 2
    hot = ranked.where("marginal_effect = 0.25").agg(F.min("rank"), F.max("rank"), F.count("*")).first()
    above = table.where("marginal_effect > 0.25").count()
    assert hot[0] == hot[1] == above + (hot[2] + 1) / 2
    assert ranked.where("size > 14").count() == 9


def test_effects_without_a_contrast_have_no_rank(spark):
    table = spark.createDataFrame(
        [("a", 1.0, 0.1), ("b", None, 0.1), ("c", 2.0, 0.1)],
        "keyword string, marginal_effect double, prop_doc double",
    )
    ranks = {r.keyword: (r["rank"], r["size"], r.color) for r in effects.effects_rank(table).collect()}
    assert ranks == {"a": (2.0, 22.0, 2.0), "b": (None, 14.0, 0.0), "c": (1.0, 23.0, 1.0)}
