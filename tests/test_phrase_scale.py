import json
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacantia.operators import features, matching, phrases, term_index, vectors
from vacantia.operators.term_index import TermIndex
from vacantia.operators.word_filter import PART_BITS, WordFilter, filter_bits
from vacantia.plans import etl, fixtures
from vacantia.sources import phrase_documents


# --- the filter of frequent words ---


def test_bits_follow_the_words_up_to_the_bound():
    assert filter_bits(0) == filter_bits(1) == PART_BITS
    assert filter_bits(1_000_000) == 1 << 24
    assert filter_bits(10**12) == 1 << 28


def test_filter_holds_every_word_and_few_others(spark):
    words = spark.range(20_000).select(F.concat(F.lit("w"), F.col("id")).alias("term"))
    found = WordFilter(words, 20_000)
    tested = spark.range(60_000).select(
        "id", found.may_hold(F.concat(F.lit("w"), F.col("id"))).alias("held")
    )
    counts = tested.groupBy((F.col("id") < 20_000).alias("inside")).agg(F.count_if("held").alias("n"))
    by = {r.inside: r.n for r in counts.collect()}
    assert by[True] == 20_000
    assert by[False] < 0.03 * 40_000


def test_filter_of_no_words(spark):
    found = WordFilter(spark.createDataFrame([], "term string"), 0)
    assert not spark.range(50).select(found.may_hold(F.col("id").cast("string")).alias("h")).filter("h").count()


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(11)
    letters = [f"{a}{b}{c}" for a in "abcdefgh" for b in "abcdefghij" for c in "abcdefghijklmnopqrst"]
    words = [f"w{x}" for x in letters[:30]] + [f"rare{x}" for x in letters]
    rows = [
        (" ".join(rng.choice(words[:30] if rng.random() < 0.6 else words) for _ in range(25)),)
        for _ in range(400)
    ]
    return spark.createDataFrame([*rows, ("",), ("waaa",), (None,)], "text string").repartition(4)


def found(table):
    return {r.term: (r.n, pytest.approx(r.lift)) for r in table.collect()}


def test_filtered_pairs_have_the_lift_of_all_pairs(texts):
    exact = etl.lifts_of(texts).filter("lift > -1")
    frequent = phrases.unigram_counts(texts).filter("n >= 15")
    filtered = phrases.filtered_pair_lift(texts, frequent, etl.document_count(texts), frequent.count())
    assert found(filtered) == found(exact) and exact.count() > 100


def test_few_pairs_reach_the_count(texts):
    frequent = phrases.unigram_counts(texts).filter("n >= 15")
    words = WordFilter(frequent, frequent.count())
    every = phrases._pairs(texts)
    passed = every.filter(words.may_hold(F.col("first")) & words.may_hold(F.col("second")))
    assert passed.distinct().count() < 0.5 * every.distinct().count()


def test_discovery_is_the_same_beyond_the_broadcast(texts):
    small = etl.discover_phrases(texts, lift_threshold=0.02)
    large = etl.discover_phrases(texts, lift_threshold=0.02, broadcast_bytes=0)
    assert found(small.bigrams) == found(large.bigrams) and small.bigrams.count() > 10


# --- one document from many tasks ---


def whole(path):
    parts = sorted(p for p in path.glob("section=*/part-*") if p.suffix == ".txt")
    return json.loads("".join(p.read_text() for p in parts))


@pytest.mark.parametrize("words, pairs", [
    ([], []),
    (["b"], []),
    (["é", "b", 'quote " and \\ back', "a", "a"], ["b c", "a b", ",x y", "[u v]"]),
])
def test_parts_are_one_document_in_order(spark, tmp_path, words, pairs):
    path = tmp_path / "phrases"
    tables = [spark.createDataFrame([(t,) for t in terms], "term string") for terms in (words, pairs)]
    phrase_documents.export_ordered(*tables, {"min_unigram_count": 15, "note": 'x, "unigrams": ['}, str(path))
    document = whole(path)
    assert document["unigrams"] == sorted(set(words), key=str.encode)
    assert document["bigrams"] == sorted(set(pairs), key=str.encode)
    assert document["parameters"]["min_unigram_count"] == 15
    assert document["artifact_sizes"] == {
        "significant_unigram_size": len(set(words)), "significant_bigram_size": len(pairs)
    }
    about = phrase_documents.read_about(spark, str(path))
    assert about["parameters"] == document["parameters"] and about["timestamp"] == document["timestamp"]
    back = phrase_documents.import_ordered(spark, str(path))
    assert [sorted(r.term for r in t.collect()) for t in back] == [sorted(set(words)), sorted(pairs)]


def test_a_million_terms_from_many_tasks(spark, tmp_path):
    path = tmp_path / "phrases"
    words = spark.range(1_000_000).select(F.sha1(F.col("id").cast("string")).alias("term"))
    pairs = spark.range(10).select(F.concat(F.lit("a "), F.col("id")).alias("term"))
    phrase_documents.export_ordered(words, pairs, {}, str(path))
    assert len(list(path.glob("section=1-unigrams/part-*"))) > 1
    document = whole(path)
    assert len(document["unigrams"]) == 1_000_000 and document["unigrams"] == sorted(document["unigrams"])
    back, _ = phrase_documents.import_ordered(spark, str(path))
    assert back.join(words, "term", "left_semi").distinct().count() == 1_000_000


# --- vocabularies too large to broadcast ---


def test_a_block_asks_once_for_each_pair_that_may_be_known(spark):
    pairs = spark.createDataFrame([("a b",), ("b a",), ("b c",), (None,), ("one",)], "term string")
    index = TermIndex.of(["a", "b", "c"], [])
    texts = pa.array(["a x b a b", "b a", None, "a b c", "c c"])
    asked = matching.asked_pairs(texts, pa.array([7, 7, 7, 9, 9]), index, matching._pair_filter(pairs))
    rows = [tuple(r.values()) for r in asked.to_pylist()]
    assert sorted(rows) == [(7, "a b"), (7, "b a"), (9, "a b"), (9, "b c")]
    words = [tuple(r.values()) for r in matching.asked_words(texts, pa.array([7, 7, 7, 9, 9])).to_pylist()]
    assert sorted(words) == [(7, ""), *((7, w) for w in "abx"), *((9, w) for w in "abc")]


def test_a_block_asks_by_number_where_all_tasks_have_the_index(spark):
    pairs = spark.createDataFrame([("a b",), ("b a",), ("b c",), (None,), ("one",), ("a x",)], "term string")
    index = TermIndex.of(["a", "b", "c"], [])
    numbers = index.numbers_of_pairs(pa.array(["a b", None, "one", "b c", "a x", "a b c", ""]))
    assert (numbers < 0).tolist() == [False, True, True, False, True, True, True]
    known = spark.createDataFrame([(int(n),) for n in index.numbers_of_pairs(
        pa.array(["a b", "b a", "b c"]))], "_pair long")
    texts = pa.array(["a x b a b", "b a", None, "a b c", "c c"])
    asked = matching.asked_numbers(texts, pa.array([7, 7, 7, 9, 9]), index, matching._number_filter(known))
    of = dict(zip(index.numbers_of_pairs(pa.array(["a b", "b a", "b c"])).tolist(), ["a b", "b a", "b c"]))
    rows = [(block, of[pair]) for block, pair in (r.values() for r in asked.to_pylist())]
    assert sorted(rows) == [(7, "a b"), (7, "b a"), (9, "a b"), (9, "b c")]
    nothing = matching.asked_numbers(
        pa.array([None, "x"]), pa.array([1, 1]), index, matching._number_filter(known)
    )
    assert nothing.num_rows == 0 and pairs.count() == 6


def test_pairs_are_counted_in_a_batch_before_they_move(texts):
    frequent = phrases.unigram_counts(texts).filter("n >= 15")
    known = {r.term for r in frequent.collect()}
    rows = [r.text for r in texts.collect()]
    index = TermIndex.of(sorted(known), [])
    counted = phrases.counted_pairs(pa.array(rows, pa.string()), index)
    words = [text.split(" ") for text in rows if text]
    expected = Counter(p for ws in words for p in zip(ws, ws[1:]) if known.issuperset(p))
    name = [term.decode() for term in index.terms.tolist()]
    low = (1 << phrases.PAIR_BITS) - 1
    found = {(name[p >> phrases.PAIR_BITS], name[p & low]): n for p, n in zip(*counted.to_pydict().values())}
    assert found == expected and len(found) > 100
    lifts = phrases.frequent_pair_lift(texts, frequent, etl.document_count(texts))
    plan = lifts._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_features_are_counted_in_a_batch_before_they_move(spark):
    rows = [(["a", "a", "b"],), (["b", None, None],), ([],), (None,), (["a"],)]
    samples = spark.createDataFrame(rows, "ngrams array<string>").repartition(2)
    found = vectors.vocabulary(samples, min_df=1)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in found.collect()] == [("a", 2, 3), (None, 1, 2), ("b", 2, 2)]


@pytest.mark.parametrize("small", [True, False])
def test_neither_words_nor_vocabularies_are_multiplied(texts, small):
    """A large vocabulary meets each text's words without a row per word or a copy per salt."""
    words = phrases.unigram_counts(texts).filter("n >= 15")
    pairs = etl.lifts_of(texts).filter("lift > 0.02")
    found = matching.match_by_joins(texts, words, pairs, False, small)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan and "explode(split" not in plan
    small_way = matching.match_by_broadcast(texts, words, pairs, False)
    row = lambda r: (str(r.text), r.unigrams, r.bigrams, r.kept)
    assert sorted(map(row, found.collect())) == sorted(map(row, small_way.collect()))


def test_only_listings_with_a_wage_are_matched_for_samples(spark, tmp_path, monkeypatch):
    """Blocks let no filter pass, so the listings without a label have to go before."""
    rng = random.Random(3)
    words = [f"w{a}{b}" for a in "abcde" for b in "abcde"]
    rows = [(i, f"src{i % 3}", " ".join(rng.choices(words, k=30))) for i in range(1, 400)]
    rows.append((400, "src0", None))
    documents = spark.createDataFrame(rows, "doc_id long, source string, text string")
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    matched = []

    def by_blocks(listings, unigrams, bigrams):
        matched.append(listings)
        return features.wages_and_features(listings, unigrams, bigrams, broadcast_bytes=0)

    monkeypatch.setattr(fixtures, "wages_and_features", by_blocks)
    views = fixtures.Views(spark, str(tmp_path))
    row = lambda r: (r.code, r.wage, r.ngrams)
    samples = sorted(map(row, views.samples.collect()))
    assert 0 < matched[0].count() == len(samples) < views.texts.count()
    every = features.labelled_samples(views.features())
    assert samples == sorted(map(row, every.collect()))


# --- more pairs than are broadcast ---


def test_many_pairs_are_files_that_tasks_write(spark, monkeypatch):
    monkeypatch.setattr(term_index, "FILE_PAIRS", 100)
    rng = random.Random(8)
    known = sorted(rng.sample(range(10**9), 1000))
    numbers = spark.createDataFrame([(n,) for n in known], "_pair long").repartition(3)
    files = term_index.ship_pairs(numbers, 1000)
    assert len(files) > 5
    parts = term_index.shipped_index(term_index.ship_index(spark, spark.range(0).select(F.lit("a").alias("term"))), files).pairs
    assert all(isinstance(part, np.memmap) for part in parts)
    assert np.concatenate(parts).tolist() == known
    asked = np.array([*rng.sample(known, 300), *(n + 1 for n in known), -1, 0, 2 * 10**9])
    assert term_index._held(parts, asked).tolist() == [n in set(known) for n in asked.tolist()]
    assert term_index.ship_pairs(numbers.limit(0), 0) == ()


@pytest.mark.parametrize("low_order", [False, True])
def test_no_text_moves_for_many_pairs(texts, monkeypatch, low_order):
    """Beyond the broadcast pairs are looked up where the texts are, up to a bound."""
    monkeypatch.setattr(term_index, "FILE_PAIRS", 50)
    monkeypatch.setattr(matching, "MATCHED_ROWS", 7)
    words = phrases.unigram_counts(texts).filter("n >= 15")
    pairs = etl.lifts_of(texts).filter("lift > 0.02")
    monkeypatch.setattr(features, "is_small", lambda table, *_: table is not pairs)
    options = {"token_pattern": None, "drop_low_order_ngrams": low_order}
    found = features.phrase_features(texts, words, pairs, **options)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Join" not in plan
    row = lambda r: (str(r.text), r.unigrams, r.bigrams, r.ngrams)
    by_blocks = features.phrase_features(texts, words, pairs, most_pairs=0, **options)
    assert "CoGroup" in by_blocks._jdf.queryExecution().optimizedPlan().toString()
    rows = sorted(map(row, found.collect()))
    assert rows == sorted(map(row, by_blocks.collect())) and any(r[2] for r in rows)


def test_counts_and_words_of_pairs_come_from_the_index(texts, spark):
    """No table of words is broadcast to every executor for the lift."""
    listings = texts.unionByName(spark.createDataFrame([(f"{'é' * 40} waaa",)] * 20, "text string"))
    counts = phrases.unigram_counts(listings)
    frequent = counts.filter("n >= 15")
    lifts = phrases.frequent_pair_lift(listings, frequent, etl.document_count(listings))
    assert "Join" not in lifts._jdf.queryExecution().optimizedPlan().toString()
    exact = etl.lifts_of(listings).filter("lift > -1")
    row = lambda r: (r.term, r.n, r.lift)
    assert sorted(map(row, lifts.collect())) == sorted(map(row, exact.collect()))
    assert lifts.filter(F.length("term") > 40).count() == 1


def test_a_batch_is_matched_a_few_texts_at_a_time(spark, monkeypatch):
    """A batch of 10,000 long texts took a worker's memory when all its words were there at once."""
    most = spark.sparkContext.broadcast(matching.MATCHED_ROWS)
    whole = matching.match_texts

    def limited(texts, *options):
        if len(texts) > most.value:
            raise MemoryError(f"{len(texts)} texts at once")
        return whole(texts, *options)

    monkeypatch.setattr(matching, "match_texts", limited)
    texts = spark.range(0, 5000, 1, 1).select(F.concat(F.lit("a b c"), F.col("id")).alias("text"))
    words, pairs = (spark.createDataFrame([(t,)], "term string") for t in ("a", "a b"))
    found = matching.match_by_broadcast(texts, words, pairs, False)
    assert found.filter("unigrams = array('a') and size(bigrams) = 0").count() == 5000
