import random
import statistics
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vacantia.functions.hashing import uniform_key, whole_quotient
from vacantia.operators import effects, splits, training_history
from vacantia.operators.network import has_stalled


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(997).select((F.col("id") * 7 + 10**9).cast("string").alias("code"))


def codes(table):
    return {r.code for r in table.collect()}


def by_hash(rows, seed):
    keyed = rows.select("code", uniform_key(F.col("code"), seed).alias("h")).collect()
    return [r.code for r in sorted(keyed, key=lambda r: (r.h, r.code))]


@pytest.mark.parametrize("share", [0.25, 0.5, 0.0, 1.0])
def test_split_has_the_exact_size(rows, share):
    train = codes(splits.train_test_split(rows, "code", share, seed=3).filter("is_train"))
    k = int(997 * (1 - share))
    assert train == set(by_hash(rows, 3)[:k])


@pytest.mark.parametrize("k", [1, 5, 400, 997, 2000])
def test_cut_search_narrows_to_the_exact_rows(rows, monkeypatch, k):
    monkeypatch.setattr(splits, "SEARCH_BINS", 4)
    monkeypatch.setattr(splits, "FINAL_BIN_ROWS", 3)
    assert codes(splits.take_sample(rows, k, "code", 9)) == set(by_hash(rows, 9)[:k])


def test_repeated_keys_are_refused(spark, monkeypatch):
    monkeypatch.setattr(splits, "FINAL_BIN_ROWS", 3)
    same = spark.range(50).select(F.lit("1").alias("code"))
    with pytest.raises(ValueError):
        splits.take_sample(same, 10, "code", 1)


def test_partitioning_does_not_change_a_split(rows):
    def both(partitions):
        table = rows.repartition(partitions)
        return (
            codes(splits.train_test_split(table, "code", 0.3).filter("is_train")),
            {(r.code, r.fold) for r in table.select("code", splits.fold_of(F.col("code")).alias("fold")).collect()},
            codes(splits.bernoulli_sample(table, 0.2, "code", 5)),
        )

    one, many = both(1), both(16)
    assert one == many
    assert 120 < len(one[2]) < 280
    sizes = Counter(fold for _, fold in one[1])
    assert set(sizes) == set(range(5)) and min(sizes.values()) > 150


def test_draws_with_replacement(rows, monkeypatch):
    monkeypatch.setattr(splits, "FINAL_BIN_ROWS", 40)
    drawn = splits.take_sample(rows, 300, "code", 11, with_replacement=True).collect()
    assert sorted(r.draw for r in drawn) == list(range(1, 301))
    order = by_hash(rows, 11)
    spark = rows.sparkSession
    ranks = spark.range(1, 301).select(
        "id", (uniform_key(F.concat(F.lit("draw"), F.col("id")), 11) % 997).alias("r")
    )
    expected = {r.id: order[r.r] for r in ranks.collect()}
    assert {r.draw: r.code for r in drawn} == expected
    assert len({r.code for r in drawn}) < 300


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = [(f"k{i}", round(rng.uniform(-2, 2), 1), rng.choice([0.01, 0.05, 0.1, 0.25, 0.3])) for i in range(60)]
    return spark.createDataFrame(rows, "keyword string, marginal_effect double, prop_doc double")


def test_rank_averages_ties(table):
    found = effects.effects_rank(table, top_n=7).toPandas().set_index("keyword").sort_index()
    frame = table.toPandas()
    frame = frame[frame.prop_doc.between(0.05, 0.25)].set_index("keyword").sort_index()
    ranks = frame.marginal_effect.rank(ascending=False)
    pd.testing.assert_series_equal(found["rank"], ranks, check_names=False)
    assert (found["size"] == [14 + (7 - r if r <= 7 else 0) for r in ranks]).all()
    assert (found["color"] == [r if r <= 7 else 0 for r in ranks]).all()
    assert found.prop_doc.max() == 25.0


def test_no_effect_in_range_gives_an_empty_table(table):
    assert effects.effects_rank(table, (0.9, 1.0)).count() == 0
    assert effects.effects_top_abs(table, (0.9, 1.0)).count() == 0


def test_largest_absolute_effects_reversed(table):
    found = [abs(r.marginal_effect) for r in effects.effects_top_abs(table, top_n=5).collect()]
    frame = table.toPandas()
    frame = frame[frame.prop_doc.between(0.05, 0.25)]
    assert found == sorted(frame.marginal_effect.abs(), reverse=True)[:5][::-1]


def test_contrast_and_proportion(spark):
    rows = [(1.0, ["a", "a", "b"]), (3.0, ["a"]), (8.0, ["b", "c"]), (4.0, ["c", "b"])]
    rows = [(w, [*n, "all"]) for w, n in rows]
    samples = spark.createDataFrame(rows, "log_wage double, ngrams array<string>")
    found = {r.keyword: (r.marginal_effect, r.prop_doc) for r in effects.term_wage_contrast(samples).collect()}
    assert found == {
        "a": (2.0 - 6.0, 0.5),
        "b": (statistics.mean([1, 8, 4]) - 3, 0.75),
        "c": (6.0 - 2.0, 0.5),
        "all": (None, 1.0),
    }
    shares = {r.keyword: (r.n_docs, r.prop_doc) for r in effects.term_prop_doc(samples).collect()}
    assert shares["a"] == (2, 0.5)


def test_early_stop_and_best_epoch_of_known_histories(spark):
    histories = {
        m: [round(2 / e + 0.5 + m * 0.001 * e, 9) for e in range(1, 101)] for m in (1, 2, 3)
    }
    histories[4] = [1000.0 / e**3 for e in range(1, 101)]
    rows = [(m, e, v) for m, vs in histories.items() for e, v in enumerate(vs, 1)]
    history = spark.createDataFrame(rows, "model int, epoch int, val_rmse double")
    stops = training_history.early_stop_epoch(history, 0.005, 30, 15).collect()
    assert {r.model: r.stop_epoch for r in stops} == {1: 49, 2: 38, 3: 33, 4: None}
    best = training_history.best_epoch(history).collect()
    assert {r.model: r.best_epoch for r in best} == {1: 45, 2: 32, 3: 26, 4: 100}
    for model, stop in ((1, 49), (2, 38), (3, 33)):
        stalled = [has_stalled(histories[model][:e], 0.005, 30, 15) for e in range(1, stop + 1)]
        assert stalled == [False] * (stop - 1) + [True]


def test_whole_quotients_are_exact_beyond_doubles(spark):
    numbers = [2**59 + 2**48 - 1, 2**59, 2**62 + 1, 0, 5, -1, -(2**48) - 1]
    table = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    found = table.select("n", whole_quotient(table["n"], 2**48).alias("q")).collect()
    assert all(r.q == r.n // 2**48 for r in found)
