import json
import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests import rules
from vacantia.operators import features, joins, matching, phrases, vectors
from vacantia.operators.joins import salted_lookup
from vacantia.operators.term_index import TermIndex
from vacantia.plans import etl
from vacantia.plans.registry import queries
from vacantia.sources import phrase_documents


def random_texts(n, seed=1):
    rng = random.Random(seed)
    # "de" is about a third of all words.
    words = ["de"] * 8 + ["python", "dev", "x1", "data", "ingles", "a", "b", "12", "sql", "rara"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 25))) for _ in range(n)]
    return [*texts, "", "unica"]


@pytest.fixture(scope="module")
def texts():
    return random_texts(400)


@pytest.fixture(scope="module")
def table(spark, texts):
    rows = [(str(i), f"{i}-{i + 10}" if i % 3 else None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "code string, wage_info string, text string").repartition(6)


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 3])
def test_lift_equals_rule(table, texts, limit):
    lifts = {r.term: r.lift for r in etl.lifts_of(table, 15, limit).collect()}
    expected = rules.lifts(texts, 15)
    assert lifts.keys() == expected.keys()
    assert all(lifts[k] == pytest.approx(v, rel=1e-12) for k, v in expected.items())


def test_significance_filters(spark):
    counts = spark.createDataFrame([("a", 15), ("b", 14), ("x1", 99)], "term string, n bigint")
    assert [r.term for r in phrases.significant_unigrams(counts).collect()] == ["a"]
    lifts = spark.createDataFrame(
        [("a b", 5, 2.0), ("a c", 5, 2.1), ("a 1", 5, 9.0), ("a d", 5, 3.0)],
        "term string, n bigint, lift double",
    )
    kept = phrases.by_lift(phrases.significant_bigrams(lifts))
    assert [r.term for r in kept.collect()] == ["a d", "a c"]


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 3])
def test_significant_phrases_either_way(table, texts, limit):
    found = etl.discover_phrases(table, 15, 0.075, broadcast_bytes=limit)
    expected = {
        k: v for k, v in rules.lifts(texts, 15).items() if v > 0.075 and k.replace(" ", "").isalpha()
    }
    lifts = {r.term: r.lift for r in found.bigrams.collect()}
    assert lifts == pytest.approx(expected, rel=1e-12) and expected
    assert found.documents == len(texts)


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("how, rows", [("left", 90), ("left_semi", 60), ("inner", 60)])
def test_salted_lookup_is_an_ordinary_join(spark, how, rows, small):
    large = spark.range(90).select(
        F.when(F.col("id") < 60, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("k"), "id"
    )
    lookup = spark.createDataFrame([("hot", 1), ("none", 2)], "k string, v int")
    found = salted_lookup(large, lookup, "k", spread_by="id", how=how, small=small)
    assert found.count() == rows


@pytest.fixture(scope="module")
def vocabulary(spark):
    words = spark.createDataFrame([(w,) for w in ("de", "python", "data", "x1", "sql")], "term string")
    pairs = spark.createDataFrame([(p,) for p in ("de python", "python data", "de de")], "term string")
    return words, pairs


@pytest.mark.parametrize("low_order", [False, True])
@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 15, 5])
def test_both_ways_of_matching_equal_the_rule(table, texts, vocabulary, low_order, limit):
    words, pairs = ({r.term for r in v.collect()} for v in vocabulary)
    found = features.phrase_features(
        table, *vocabulary, drop_low_order_ngrams=low_order, broadcast_bytes=limit
    )
    for r in found.collect():
        expected = rules.features(texts[int(r.code)], words, pairs, low_order)
        assert (r.unigrams, r.bigrams, r.ngrams) == expected


def test_matching_without_token_pattern_and_with_odd_spaces(spark, vocabulary):
    odd = spark.createDataFrame([("1", "X1\tde\xa0 DE\n")], "code string, text string")
    row = features.phrase_features(odd, *vocabulary, token_pattern=None).first()
    assert (row.unigrams, row.bigrams) == (["x1", "de", "de"], ["de de"])


def test_empty_vocabulary_gives_no_features(table, vocabulary):
    none = vocabulary[0].filter("false")
    rows = features.phrase_features(table, none, none).select("ngrams").distinct().collect()
    assert [r.ngrams for r in rows] == [[]]


def test_labels_and_validity(spark):
    rows = [(10.0, ["a"]), (None, []), (0.0, ["a"]), (1.0, None), (5.0, ["a", None])]
    samples = spark.createDataFrame(rows, "wage double, ngrams array<string>")
    assert tuple(features.sample_validity(samples).first()) == (5, 3, 0.6)
    with pytest.raises(ValueError):
        features.valid_samples(samples)
    assert features.valid_samples(samples, 0.6).count() == 3
    with pytest.raises(ValueError):
        features.valid_samples(samples.filter("false"))
    assert tuple(features.label_counts(samples).first()) == (3, 1, 1)
    labelled = features.labelled_samples(samples.filter("ngrams is not null")).collect()
    assert sorted(r.wage for r in labelled) == [5.0, 10.0]
    assert labelled[0].log_wage == pytest.approx(2.302585092994046)


@pytest.mark.parametrize("partitions", [1, 16])
def test_vocabulary_order_and_vectors(spark, partitions):
    docs = [["b", "a", "a"], ["a", "b"], ["c", "b", "d"], ["c", "d"]]
    samples = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "i int, ngrams array<string>")
    samples = samples.repartition(partitions)
    terms = vectors.vocabulary(samples, min_df=2)
    assert [tuple(r) for r in terms.collect()] == [("a", 2, 3), ("b", 3, 3), ("c", 2, 2), ("d", 2, 2)]
    assert [r.term for r in vectors.vocabulary(samples, 2, cap=1).collect()] == ["a"]
    vectorised, names = vectors.vectorize(samples, min_df=3)
    assert names == ["b"]
    rows = {r.i: r.p for r in vectorised.select("i", vectors.present_features().alias("p")).collect()}
    assert rows == {0: [0], 1: [0], 2: [0], 3: []}
    with pytest.raises(ValueError):
        vectors.vectorize(samples, min_df=9)


def test_phrases_round_trip_over_several_documents(spark, tmp_path):
    words = spark.createDataFrame([(f"w{i}",) for i in range(30)], "term string")
    pairs = spark.createDataFrame([("w1 w2",)], "term string")
    path = str(tmp_path / "phrases")
    phrase_documents.export_phrases(words, pairs, {"min_unigram_count": 15}, path, documents=4)
    documents = phrase_documents.read_phrase_documents(spark, path).collect()
    assert len(documents) == 4
    assert {d.artifact_sizes.significant_unigram_size for d in documents} == {30}
    assert {d.parameters.min_unigram_count for d in documents} == {15}
    found = phrase_documents.import_phrases(spark, path)
    assert [{r.term for r in t.collect()} for t in found] == [{f"w{i}" for i in range(30)}, {"w1 w2"}]


def test_import_of_a_plain_document(spark, tmp_path):
    path = tmp_path / "export.json"
    path.write_text(json.dumps({"unigrams": ["a", "b"], "parameters": {}}, indent=4))
    unigrams, bigrams = phrase_documents.import_phrases(spark, str(path))
    assert sorted(r.term for r in unigrams.collect()) == ["a", "b"]
    assert bigrams.count() == 0


def test_import_errors(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        phrase_documents.import_phrases(spark, str(tmp_path / "none"))
    (tmp_path / "bad.json").write_text('{"unigrams": ["a"')
    with pytest.raises(Exception):
        phrase_documents.import_phrases(spark, str(tmp_path / "bad.json"))[0].collect()


def test_tokens_query_uses_the_token_rule(spark):
    row = queries()["tokens"](spark, "/root/testdata/sf0.001").first()
    assert all(t.isascii() and t.isalpha() for t in row.tokens.split(","))


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 3])
def test_pairs_with_rare_words_count_the_same_at_every_size(spark, limit):
    rows = [(str(i), "x y x y z") for i in range(3)] + [("9", "x q")]
    table = spark.createDataFrame(rows, "code string, text string")
    found = etl.discover_phrases(table, 4, -2.0, broadcast_bytes=limit)
    assert {r.term: r.lift for r in found.bigrams.collect()} == {
        "x y": 6 / (7 * 6 / 4), "y x": 3 / (6 * 7 / 4), "y z": -1.0, "x q": -1.0
    }


@pytest.mark.parametrize("limit", [joins.BROADCAST_BYTES, 1])
def test_rows_without_or_with_one_code_are_told_apart(spark, limit):
    words = spark.createDataFrame([("x",), ("y",)], "term string")
    pairs = spark.createDataFrame([("x y",)], "term string")
    rows = [(None, "x y"), ("1", "x y"), ("1", "y x y"), ("1", "x y"), ("2", None), ("3", "q")]
    table = spark.createDataFrame(rows, "code string, text string")
    found = features.phrase_features(table, words, pairs, broadcast_bytes=limit)
    assert sorted((str(r.code), r.ngrams) for r in found.collect()) == sorted([
        ("None", ["x", "y", "x y"]), ("1", ["x", "y", "x y"]), ("1", ["y", "x", "y", "x y"]),
        ("1", ["x", "y", "x y"]), ("2", []), ("3", []),
    ])


def test_no_feature_is_left_out_silently(spark):
    rows = spark.createDataFrame([(["a", "b", "c"],)] * 3, "ngrams array<string>")
    assert vectors.vocabulary(rows, 1).count() == 3
    with pytest.raises(ValueError, match="3 features"):
        vectors.vectorize(rows, 1, max_features=2)


def test_features_are_taken_however_many_there_are(spark):
    many = 270_000
    rows = spark.range(many).select(F.array(F.concat(F.lit("t"), "id")).alias("ngrams"))
    vectorised, names = vectors.vectorize(rows, 1)
    assert len(names) == many and names[:2] == ["t0", "t1"]
    held = vectorised.select(vectors.present_features().alias("p"))
    assert held.agg(F.count_distinct("p")).first()[0] == many


@pytest.mark.parametrize("most", [1, 3, 1 << 19])
def test_features_are_counted_a_few_at_a_time(monkeypatch, most):
    monkeypatch.setattr(vectors, "COUNTED_FEATURES", most)
    docs = [["b", "a", "a"], [], None, ["a", "b"], ["c", "b", "d"], ["c", "d"]]
    batch = pa.RecordBatch.from_pydict({"ngrams": pa.array(docs, pa.list_(pa.string()))})
    found, most_terms = Counter(), 0
    for part in vectors._term_counts([batch]):
        most_terms = max(most_terms, sum(part["w"].to_pylist()))
        for term, d, w in zip(*(part[name].to_pylist() for name in ("term", "d", "w"))):
            found[term, "d"] += d
            found[term, "w"] += w
    assert found == {
        ("a", "d"): 2, ("a", "w"): 3, ("b", "d"): 3, ("b", "w"): 3,
        ("c", "d"): 2, ("c", "w"): 2, ("d", "d"): 2, ("d", "w"): 2,
    }
    # One sample, which may have more, or as many as were asked for.
    assert most_terms <= max(most, 3)


def test_matched_texts_leave_a_worker_a_few_at_a_time(monkeypatch):
    monkeypatch.setattr(matching, "MATCHED_ROWS", 2)
    texts = [pa.array(["x y", "y x", "x", "y", "x y x"]), pa.array([], pa.string())]
    parts = list(matching.match_batches(iter(texts), TermIndex.of(["x", "y"], ["x y"]), False))
    assert [len(p) for p in parts] == [2, 2, 1]
    assert [found for p in parts for found in p.field("bigrams").to_pylist()] == [["x y"], [], [], [], ["x y"]]
