"""Matching the words of listings against phrase vocabularies.

Three ways with one result. A vocabulary whose measured size is small is sent to every machine as
an index, in which each Arrow batch of texts is looked up: no row moves. So are more pairs, up to
a bound, as files of their numbers that tasks have written. Of a larger vocabulary each block of
texts gets the part that it needs, by joins on the terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.functions.text import spaced_lower
from vacantia.operators.term_index import TermIndex, ship_index, ship_pairs, shipped_index, sorted_once
from vacantia.operators.word_filter import WordFilter
from vacantia.scratch import stage

# Rows that are looked up together are 2 to the power of so many, of one task.
BLOCK_BITS = 9
# Texts of an Arrow batch whose words are in memory at a time.
MATCHED_ROWS = 1024
BLOCK, SPACED, PAIR = "_block", "_spaced", "_pair"
MATCHED = ("unigrams", "bigrams", "kept")
ODD = 0x5851F42D4C957F2D
MIXERS = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)


def _lists(values: pa.Array, rows: np.ndarray, size: int) -> pa.Array:
    """Values as lists per row; `rows` holds the ascending row of each value."""
    ends = np.cumsum(np.bincount(rows, minlength=size))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), values)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    """A column of a group in one piece."""
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def pieces_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of a batch of single-spaced texts, and the row of each."""
    pieces = pc.split_pattern(pc.fill_null(texts, ""), " ")
    return pieces.flatten(), np.repeat(np.arange(len(texts)), np.diff(pieces.offsets.to_numpy()))


def _known_words(texts: pa.Array, index: TermIndex) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words that the index holds, the row of each and its number."""
    words, rows = pieces_of(texts)
    ids = index.ids(words)
    known = ids >= 0
    return words.filter(pa.array(known)), rows[known], ids[known]


def _word_hashes(words: pa.Array) -> np.ndarray:
    """64 uniform bits of each word."""
    encoded = words.dictionary_encode()
    digests = [blake2b(word, digest_size=8).digest() for word in encoded.dictionary.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(digests), np.int64)[encoded.indices.to_numpy()]


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return first * np.int64(ODD) + second


def match_texts(texts: pa.Array, index: TermIndex, drop_low_order: bool = False) -> pa.Array:
    """(unigrams, bigrams, kept) lists of a batch of single-spaced texts."""
    size = len(texts)
    unigrams, rows, ids = _known_words(texts, index)
    # Pair i joins unigram i and the next one, of the same text or not.
    neighbours = rows[:-1] == rows[1:]
    hits = neighbours & index.know(ids[:-1], ids[1:])
    unigram_lists = _lists(unigrams, rows, size)
    if drop_low_order:
        left = neighbours & ~hits
        kept = _lists(unigrams[:-1].filter(pa.array(left)), rows[:-1][left], size)
    else:
        kept = unigram_lists
    first, second = (side.filter(pa.array(hits)) for side in (unigrams[:-1], unigrams[1:]))
    joined = pc.binary_join_element_wise(first, second, " ")
    bigram_lists = _lists(joined, rows[:-1][hits], size)
    return pa.StructArray.from_arrays(
        [unigram_lists, bigram_lists, kept], names=[*MATCHED]
    )


def match_batches(
    batches: Iterator[pa.Array], index: TermIndex, drop_low_order: bool
) -> Iterator[pa.Array]:
    """The lists of all texts in order, given back a few texts at a time: those of a whole batch
    take several times the memory of its texts."""
    for texts in batches:
        for at in range(0, len(texts), MATCHED_ROWS):
            yield match_texts(texts.slice(at, MATCHED_ROWS), index, drop_low_order)


def _match_in_place(
    listings: DataFrame, index: str, pair_files: tuple[str, ...] | None, drop_low_order: bool
) -> DataFrame:
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from match_batches(batches, shipped_index(index, pair_files), drop_low_order)

    matcher = F.arrow_udf(
        match, "unigrams array<string>, bigrams array<string>, kept array<string>"
    )
    matched = listings.withColumn("_matched", matcher(spaced_lower(F.col("text"))))
    return matched.select(*listings.columns, "_matched.*")


def match_by_broadcast(
    listings: DataFrame, unigrams: DataFrame, bigrams: DataFrame, drop_low_order: bool
) -> DataFrame:
    """Add `unigrams`, `bigrams` and `kept` (the unigrams that stay features).

    For vocabularies that were measured to be small.
    """
    index = ship_index(listings.sparkSession, unigrams, bigrams)
    return _match_in_place(listings, index, None, drop_low_order)


def match_by_pair_files(
    listings: DataFrame, unigrams: DataFrame, bigrams: DataFrame, drop_low_order: bool, pairs: int
) -> DataFrame:
    """The same for few unigrams and so many bigrams, which pass no driver: tasks number and
    sort them and write the files that every machine maps. No text moves."""
    index = ship_index(listings.sparkSession, unigrams)
    files = ship_pairs(_numbered_pairs(bigrams, index), pairs)
    return _match_in_place(listings, index, files, drop_low_order)


def _block_codes(blocks: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different blocks of a batch, and the place among them of each listed row's block."""
    different, codes = np.unique(blocks.to_numpy(), return_inverse=True)
    return different, codes[rows]


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """64 uniform bits of each number."""
    bits = numbers.view(np.uint64)
    for factor in MIXERS:
        bits = (bits ^ (bits >> np.uint64(33))) * np.uint64(factor)
    return (bits ^ (bits >> np.uint64(33))).view(np.int64)


def _asked(blocks: np.ndarray, terms: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), terms], names=[BLOCK, "term"])


def asked_words(texts: pa.Array, blocks: pa.Array) -> pa.RecordBatch:
    """(block, term): each word of a batch of texts, once in a block."""
    pieces, rows = pieces_of(texts)
    encoded = pieces.dictionary_encode()
    different, codes = _block_codes(blocks, rows)
    size = max(len(encoded.dictionary), 1)
    once = np.unique(codes * size + encoded.indices.to_numpy())
    return _asked(different[once // size], encoded.dictionary.take(pa.array(once % size)))


def asked_pairs(
    texts: pa.Array, blocks: pa.Array, index: TermIndex, pairs: WordFilter
) -> pa.RecordBatch:
    """(block, term): each pair of neighbours among the known words that the filter lets pass,
    once in a block."""
    words, rows, ids = _known_words(texts, index)
    hashes = _word_hashes(words)
    neighbours = rows[:-1] == rows[1:]
    starts = np.flatnonzero(neighbours & pairs.holds(_pair_hashes(hashes[:-1], hashes[1:])))
    different, codes = _block_codes(blocks, rows[starts])
    numbers = index.pair_numbers(ids[starts], ids[starts + 1])
    order = np.lexsort((numbers, codes))
    numbers, codes = numbers[order], codes[order]
    once = np.ones(len(order), bool)
    once[1:] = (numbers[1:] != numbers[:-1]) | (codes[1:] != codes[:-1])
    at = starts[order[once]]
    terms = pc.binary_join_element_wise(words.take(pa.array(at)), words.take(pa.array(at + 1)), " ")
    return _asked(different[codes[once]], terms)


def asked_numbers(
    texts: pa.Array, blocks: pa.Array, index: TermIndex, pairs: WordFilter
) -> pa.RecordBatch:
    """(block, pair): the same by the numbers of an index that all tasks share."""
    _, rows, ids = _known_words(texts, index)
    neighbours = rows[:-1] == rows[1:]
    numbers = index.pair_numbers(ids[:-1][neighbours], ids[1:][neighbours])
    held = pairs.holds(_mixed(numbers))
    different, codes = _block_codes(blocks, rows[:-1][neighbours][held])
    numbers = numbers[held]
    parts = [sorted_once(numbers[codes == code]) for code in range(len(different))]
    of_block = np.repeat(different, [len(part) for part in parts])
    asked = [pa.array(side, pa.int64()) for side in (of_block, np.concatenate([numbers[:0], *parts]))]
    return pa.RecordBatch.from_arrays(asked, names=[BLOCK, PAIR])


def _numbered_pairs(bigrams: DataFrame, shipped: str) -> DataFrame:
    """The numbers of the pairs in the shipped index; others can't be found."""

    def number(terms: pa.Array) -> pa.Array:
        return pa.array(shipped_index(shipped).numbers_of_pairs(terms))

    numbers = bigrams.select(F.arrow_udf(number, "long")("term").alias(PAIR))
    return stage(numbers.filter(F.col(PAIR) >= 0), "pair-numbers")


def _number_filter(pairs: DataFrame) -> WordFilter:
    def hashed(numbers: pa.Array) -> pa.Array:
        return pa.array(_mixed(numbers.to_numpy()))

    hashes = pairs.select(F.arrow_udf(hashed, "long")(PAIR).alias("hash"))
    return WordFilter(hashes, pairs.count(), F.col("hash"))


def _pair_filter(bigrams: DataFrame) -> WordFilter:
    """Of the hashes of pairs, as they are made from those of their words."""

    def hashed(terms: pa.Array) -> pa.Array:
        sides = [pc.list_element(pc.split_pattern(terms, " "), k) for k in (0, 1)]
        return pa.array(_pair_hashes(*map(_word_hashes, sides)))

    # What is no two words is no pair of neighbours.
    pairs = bigrams.select("term").filter(F.size(F.split("term", " ")) == 2)
    hashes = pairs.select(F.arrow_udf(hashed, "long")("term").alias("hash"))
    return WordFilter(hashes, bigrams.count(), F.col("hash"))


def _found(asked: DataFrame, vocabulary: DataFrame, key: str = "term") -> DataFrame:
    """The asked terms that the vocabulary holds. One is asked once in a block, so none is hot."""
    return asked.join(vocabulary.select(key), key, "left_semi").select(BLOCK, key)


def match_by_joins(
    listings: DataFrame,
    unigrams: DataFrame,
    bigrams: DataFrame,
    drop_low_order: bool,
    small_unigrams: bool = False,
) -> DataFrame:
    """The same for vocabularies of any size. A block of rows asks for its different words and
    pairs, gets back those that are known, and looks its texts up in an index of these alone:
    what moves are the texts, once, and the known terms of each block. Blocks are numbered in a
    written table, so no column has to be unique or filled."""
    spark = listings.sparkSession
    text = F.col("text")
    # NULL where the text is already as it is looked up, so that nothing moves twice.
    spaced = F.when(spaced_lower(text) != text, spaced_lower(text)).alias(SPACED)
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias(BLOCK)
    blocks = stage(listings.select("*", spaced, block), "blocks")
    texts = blocks.select(F.coalesce(SPACED, "text").alias("text"), BLOCK)
    names = listings.columns
    # Unless some are dropped, the unigrams are what is kept.
    lists = MATCHED if drop_low_order else MATCHED[:2]
    if small_unigrams:
        # Words and pairs have the same numbers everywhere, so no term is asked for by its text.
        shipped = ship_index(spark, unigrams)
        numbered = _numbered_pairs(bigrams, shipped)
        wanted = _number_filter(numbered)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield asked_numbers(batch["text"], batch[BLOCK], shipped_index(shipped), wanted)

        known = _found(texts.mapInArrow(ask, f"{BLOCK} long, {PAIR} long"), numbered, PAIR)

        def index_of(known: pa.Table) -> TermIndex:
            return shipped_index(shipped).with_pair_numbers(_whole(known[PAIR]).to_numpy())
    else:
        asked_schema = f"{BLOCK} long, term string"
        wanted = _pair_filter(bigrams)

        def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield asked_words(batch["text"], batch[BLOCK])

        # Most other words are dropped before anything moves.
        may_hold = WordFilter(unigrams, unigrams.count()).may_hold
        every = texts.mapInArrow(ask_words, asked_schema).filter(may_hold(F.col("term")))
        words = stage(_found(every, unigrams), "block-words")

        def ask_of_block(rows: pa.Table, known: pa.Table) -> pa.Table:
            index = TermIndex.of(known["term"].to_pylist(), [])
            asked = asked_pairs(_whole(rows["text"]), _whole(rows[BLOCK]), index, wanted)
            return pa.Table.from_batches([asked])

        pairs = (
            texts.groupBy(BLOCK).cogroup(words.groupBy(BLOCK)).applyInArrow(ask_of_block, asked_schema)
        )
        known = _found(pairs, bigrams).withColumn(PAIR, F.lit(True))
        known = known.unionByName(words.withColumn(PAIR, F.lit(False)))

        def index_of(known: pa.Table) -> TermIndex:
            is_pair = known[PAIR]
            words = known["term"].filter(pc.invert(is_pair)).to_pylist()
            return TermIndex.of(words, known["term"].filter(is_pair).to_pylist())

    def match(rows: pa.Table, known: pa.Table) -> pa.Table:
        texts = pc.coalesce(_whole(rows[SPACED]), _whole(rows["text"]))
        matched = match_texts(texts, index_of(known), drop_low_order)
        made = [matched.field(name) for name in lists]
        return pa.Table.from_arrays([*(rows[name] for name in names), *made], names=[*names, *lists])

    fields = [T.StructField(name, T.ArrayType(T.StringType())) for name in lists]
    schema = T.StructType([*listings.schema.fields, *fields])
    found = blocks.groupBy(BLOCK).cogroup(known.groupBy(BLOCK)).applyInArrow(match, schema)
    return found if drop_low_order else found.withColumn("kept", F.col("unigrams"))
