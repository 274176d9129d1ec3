"""Word and word-pair statistics: counts, lift, significant phrases."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.ngrams import neighbour_structs
from vacantia.functions.text import standard_words
from vacantia.operators.joins import salted_lookup
from vacantia.operators.matching import pieces_of
from vacantia.operators.term_index import TermIndex, ship_counts, ship_index, shipped_counts, shipped_index
from vacantia.operators.word_filter import WordFilter
from vacantia.scratch import stage

# --- fixed value: the lift of a pair with a rare word ---
RARE_LIFT = -1.0
# --- end of fixed value ---
PAIR_BITS = 32
# Texts whose words are in memory at a time.
COUNTED_ROWS = 2048


def unigram_counts(listings: DataFrame) -> DataFrame:
    """(term, n) over all words of standardised text."""
    return (
        listings.select(F.explode(standard_words(F.col("text"))).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )


def _pairs(listings: DataFrame) -> DataFrame:
    words = listings.select(standard_words(F.col("text")).alias("words"))
    return words.select(F.inline(neighbour_structs(F.col("words"))).alias("first", "second"))


def bigram_counts(listings: DataFrame) -> DataFrame:
    """(first, second, n) over neighbouring words inside one listing."""
    return _pairs(listings).groupBy("first", "second").agg(F.count("*").alias("n"))


def pair_term() -> Column:
    return F.concat(F.col("first"), F.lit(" "), F.col("second"))


def bigram_lift(
    unigrams: DataFrame,
    bigrams: DataFrame,
    documents: Column,
    min_unigram_count: int = C.MIN_UNIGRAM_COUNT,
    small: bool = False,
) -> DataFrame:
    """(term, n, lift). Lift is -1 when either word is rarer than the minimum.

    Rare words are dropped before the joins; their pairs stay through the outer join.
    `small` says that the frequent words were measured and fit a broadcast.
    """
    frequent = unigrams.filter(F.col("n") >= min_unigram_count)
    first = frequent.select(F.col("term").alias("first"), F.col("n").alias("n_first"))
    second = frequent.select(F.col("term").alias("second"), F.col("n").alias("n_second"))
    counted = salted_lookup(bigrams, first, "first", spread_by="second", small=small)
    counted = salted_lookup(counted, second, "second", spread_by="first", small=small)
    expected = F.col("n_first").cast("double") * F.col("n_second") / documents
    lift = F.when(
        F.col("n_first").isNotNull() & F.col("n_second").isNotNull(), F.col("n") / expected
    ).otherwise(F.lit(RARE_LIFT))
    return counted.select(pair_term().alias("term"), "n", lift.alias("lift"))


def counted_pairs(texts: pa.Array, index: TermIndex) -> pa.RecordBatch:
    """(pair, n) of neighbouring words of a batch of texts, both known. A pair is the number of
    its first word, PAIR_BITS higher than that of its second."""
    words, rows = pieces_of(texts)
    ids = index.ids(words)
    known = ids >= 0
    both = (rows[:-1] == rows[1:]) & known[:-1] & known[1:]
    pairs, n = np.unique((ids[:-1][both] << PAIR_BITS) + ids[1:][both], return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n, pa.int64())], names=["pair", "n"])


def _sides(pairs: pa.Array) -> list[np.ndarray]:
    """The numbers of both words of each pair."""
    numbers = pairs.to_numpy()
    return [numbers >> PAIR_BITS, numbers & ((1 << PAIR_BITS) - 1)]


def frequent_pair_lift(listings: DataFrame, frequent: DataFrame, documents: Column) -> DataFrame:
    """(term, n, lift) of the pairs of frequent words, for a small `frequent` (term, n).

    The words are looked up before the pairs are counted: pairs with a rare word, most of
    the distinct ones, never reach the shuffle. Pairs are counted as numbers, which are
    shorter than words, first within a batch of texts, and get their words back afterwards from
    the index that every machine has.
    """
    # Written, so that the index and the counts see the same words.
    words = stage(frequent, "frequent-words")
    index = ship_index(listings.sparkSession, words)
    ship_counts(words, index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED_ROWS):
                yield counted_pairs(batch.slice(at, COUNTED_ROWS)["text"], shipped_index(index))

    def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [pa.array(shipped_counts(index)[side]) for side in _sides(batch["pair"])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *sides], names=["pair", "n", "n_first", "n_second"])

    def term_of(pairs: pa.Array) -> pa.Array:
        return pc.binary_join_element_wise(*map(shipped_index(index).words, _sides(pairs)), " ")

    counted = (
        listings.select("text")
        .mapInArrow(count, "pair long, n long")
        .groupBy("pair")
        .agg(F.sum("n").alias("n"))
        # No column: a filter on the lift goes before the words come back.
        .mapInArrow(add_counts, "pair long, n long, n_first long, n_second long")
    )
    expected = F.col("n_first").cast("double") * F.col("n_second") / documents
    return counted.withColumn("lift", F.col("n") / expected).select(
        F.arrow_udf(term_of, "string")("pair").alias("term"), "n", "lift"
    )


def filtered_pair_lift(
    listings: DataFrame, frequent: DataFrame, documents: Column, frequent_words: int
) -> DataFrame:
    """The same for frequent words of any size. A Bloom filter of them drops nearly all pairs
    with a rare word before pairs are counted; the joins afterwards drop the rest."""
    words = WordFilter(frequent, frequent_words)
    pairs = _pairs(listings).filter(words.may_hold(F.col("first")) & words.may_hold(F.col("second")))
    counted = pairs.groupBy("first", "second").agg(F.count("*").alias("n"))
    first = frequent.select(F.col("term").alias("first"), F.col("n").alias("n_first"))
    second = frequent.select(F.col("term").alias("second"), F.col("n").alias("n_second"))
    found = salted_lookup(counted, first, "first", spread_by="second", how="inner")
    found = salted_lookup(found, second, "second", spread_by="first", how="inner")
    expected = F.col("n_first").cast("double") * F.col("n_second") / documents
    return found.select(pair_term().alias("term"), "n", (F.col("n") / expected).alias("lift"))


def significant_unigrams(
    unigrams: DataFrame,
    min_count: int = C.MIN_UNIGRAM_COUNT,
    pattern: str = C.PHRASE_PATTERN,
) -> DataFrame:
    return unigrams.filter((F.col("n") >= min_count) & F.col("term").rlike(pattern))


def significant_bigrams(
    lifts: DataFrame,
    threshold: float = C.LIFT_THRESHOLD,
    pattern: str = C.PHRASE_PATTERN,
) -> DataFrame:
    return lifts.filter((F.col("lift") > threshold) & F.col("term").rlike(pattern))


def by_lift(bigrams: DataFrame) -> DataFrame:
    return bigrams.orderBy(F.desc("lift"), "term")
