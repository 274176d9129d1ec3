"""An index of a phrase vocabulary, built once and mapped into every worker's memory.

Words have the number of their place among the sorted terms; a pair is a number made of two of
those. Both are sorted arrays in files that Spark copies to each machine, so the workers of a
machine share one copy and nothing is built for a batch. Lookups are binary searches over a
batch's different words. The numbers of many pairs are written by tasks, as several files.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession

from vacantia.scratch import fresh_folder
from vacantia.sources.commit_log import qualified

# What every machine gets as files has a bound: 4 million words, which the driver sorts in
# 200 MB, and 64 million pairs of 8 bytes, which it does not see.
MOST_WORDS = 1 << 22
MOST_PAIRS = 1 << 26
FILE_PAIRS = 1 << 22
# Terms that are padded at a time.
PADDED_TERMS = 1 << 16
# Terms of more bytes, of which there are few, are kept beside the array of fixed width.
WIDTH = 48


def sorted_once(values: np.ndarray) -> np.ndarray:
    """The different values in order, which takes a sort less time than `np.unique` its table."""
    ordered = np.sort(values)
    return ordered[np.r_[True, ordered[1:] != ordered[:-1]]] if len(ordered) else ordered


def _starts(terms: np.ndarray) -> np.ndarray:
    """The first eight bytes of each term as a number, in the order of the terms."""
    octets = np.ascontiguousarray(terms).view(np.uint8).reshape(len(terms), WIDTH)[:, :8]
    return np.ascontiguousarray(octets).view(">u8").reshape(-1).astype(np.uint64)


def _fixed_width(terms: pa.Array) -> np.ndarray:
    """Short terms as numpy has them."""
    if not len(terms):
        return np.empty(0, f"S{WIDTH}")
    lengths = pc.binary_length(terms).to_numpy()
    offsets = np.frombuffer(terms.buffers()[1], np.int32)[terms.offset :][: len(terms)]
    used = int(lengths.sum())
    start = int(offsets[0])
    octets = np.frombuffer(terms.buffers()[2] or b"", np.uint8)[start : start + used]
    padded = np.zeros((len(terms), WIDTH), np.uint8)
    rows = np.repeat(np.arange(len(terms)), lengths)
    padded[rows, np.arange(used) - np.repeat(offsets - start, lengths)] = octets
    return padded.reshape(-1).view(f"S{WIDTH}")


def _sorted_terms(words: list[pa.Array]) -> tuple[np.ndarray, list[bytes]]:
    """The different words in order: the short ones as an array, and the others."""
    short, others = [np.empty(0, f"S{WIDTH}")], set()
    for part in words:
        for at in range(0, len(part), PADDED_TERMS):
            terms = part.slice(at, PADDED_TERMS).drop_null().cast(pa.binary())
            # An array of fixed width loses zeros at the end of a term.
            fits = pc.and_not(pc.less_equal(pc.binary_length(terms), WIDTH), pc.ends_with(terms, "\0"))
            short.append(_fixed_width(terms.filter(fits)))
            others.update(terms.filter(pc.invert(fits)).to_pylist())
    return sorted_once(np.concatenate(short)), sorted(others)


def _held(parts: list[np.ndarray], asked: np.ndarray) -> np.ndarray:
    """Which numbers are in sorted parts, each of which ends before the next begins. They are
    looked up in order, so that a lookup is near the one before."""
    order = np.argsort(asked)
    ordered = asked[order]
    held = np.zeros(len(asked), bool)
    cuts = np.searchsorted(ordered, [part[0] for part in parts[1:]])
    for part, start, end in zip(parts, [0, *cuts], [*cuts, len(asked)]):
        mine = ordered[start:end]
        at = np.minimum(np.searchsorted(part, mine), len(part) - 1)
        held[order[start:end]] = part[at] == mine
    return held


class TermIndex:
    """Numbers of words, and which pairs of numbers are known, as one array or as parts."""

    def __init__(
        self,
        terms: np.ndarray,
        long_terms: list[bytes],
        pairs: np.ndarray | list[np.ndarray],
        starts: np.ndarray | None = None,
    ):
        self.terms, self.pairs = terms, pairs
        self.starts = _starts(terms) if starts is None else starts
        self.long = {term: len(terms) + i for i, term in enumerate(long_terms)}
        self.size = len(terms) + len(long_terms)

    @classmethod
    def of(cls, words: list[str], pairs: list[str]) -> TermIndex:
        """From words, and pairs written as two words and a space. Pairs of words that are not
        there can't be found, so they are left out."""
        index = cls(*_sorted_terms([pa.array(words, pa.string())]), np.empty(0, np.int64))
        return index.with_pairs(pairs)

    def with_pairs(self, pairs: list[str]) -> TermIndex:
        """The same words with other pairs."""
        numbers = self.numbers_of_pairs(pa.array(pairs, pa.string()))
        return self.with_pair_numbers(numbers[numbers >= 0])

    def with_pair_numbers(self, numbers: np.ndarray) -> TermIndex:
        return TermIndex(self.terms, list(self.long), sorted_once(numbers), self.starts)

    def numbers_of_pairs(self, pairs: pa.Array) -> np.ndarray:
        """The number of each pair, -1 for what is not two known words."""
        halves = pc.split_pattern(pairs, " ")
        two = pc.fill_null(pc.equal(pc.list_value_length(halves), 2), False)
        words = self.ids(halves.filter(two).flatten())
        first, second = words[0::2], words[1::2]
        numbers = np.full(len(pairs), -1, np.int64)
        known = (first >= 0) & (second >= 0)
        numbers[two.to_numpy(zero_copy_only=False)] = np.where(
            known, self.pair_numbers(first, second), -1
        )
        return numbers

    def ids(self, words: pa.Array) -> np.ndarray:
        """The number of each word, -1 if it is not in the vocabulary."""
        encoded = words.dictionary_encode()
        distinct = encoded.dictionary.cast(pa.binary())
        found = np.full(len(distinct) + 1, -1, np.int64)
        short = pc.and_not(
            pc.less_equal(pc.binary_length(distinct), WIDTH), pc.ends_with(distinct, "\0")
        )
        if len(self.terms):
            asked = _fixed_width(distinct.filter(short))
            at, alike = self._first_alike(asked)
            # Only words that begin like several terms need the comparison of whole terms.
            many = alike > 1
            at[many] = np.minimum(np.searchsorted(self.terms, asked[many]), len(self.terms) - 1)
            some = np.flatnonzero(alike)
            places = np.flatnonzero(short.to_numpy(zero_copy_only=False))[some]
            found[places] = np.where(self.terms[at[some]] == asked[some], at[some], -1)
        if self.long:
            for i in np.flatnonzero(~short.to_numpy(zero_copy_only=False)):
                found[i] = self.long.get(distinct[i].as_py(), -1)
        return found[encoded.indices.fill_null(len(distinct)).to_numpy()]

    def _first_alike(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of the first term that begins like each asked one, and how many do."""
        different, codes = np.unique(_starts(asked), return_inverse=True)
        first, end = (np.searchsorted(self.starts, different, side) for side in ("left", "right"))
        return first[codes], (end - first)[codes]

    def pair_numbers(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        return first * self.size + second

    def words(self, ids: np.ndarray) -> pa.Array:
        """The words of these numbers."""
        different, codes = np.unique(ids, return_inverse=True)
        short = different[different < len(self.terms)]
        others = list(self.long)
        found = [*self.terms[short].tolist(), *(others[i - len(self.terms)] for i in different[len(short) :])]
        return pa.array(found, pa.binary()).cast(pa.string()).take(pa.array(codes))

    def know(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair of word numbers is a pair of the vocabulary."""
        if not len(self.pairs):
            return np.zeros(len(first), bool)
        asked = self.pair_numbers(first, second)
        if isinstance(self.pairs, list):
            return _held(self.pairs, asked)
        at = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        return self.pairs[at] == asked


def _ship(spark: SparkSession, name: str, values: np.ndarray) -> None:
    path = os.path.join(tempfile.mkdtemp(prefix="vacantia-terms-"), f"{name}.npy")
    np.save(path, values, allow_pickle=values.dtype == object)
    spark.sparkContext.addFile(path)


def ship_index(spark: SparkSession, unigrams: DataFrame, bigrams: DataFrame | None = None) -> str:
    """Build the index of two tables of `term`, which were measured to be small, and send its
    files; returns their name for `shipped_index`."""

    def terms_of(table: DataFrame) -> list[pa.Array]:
        return table.select("term").where("term is not null").toArrow().column(0).chunks

    index = TermIndex(*_sorted_terms(terms_of(unigrams)), np.empty(0, np.int64))
    if bigrams is not None:
        index = index.with_pairs([pair for part in terms_of(bigrams) for pair in part.to_pylist()])
    name = f"terms-{uuid.uuid4().hex}"
    parts = {"terms": index.terms, "long": np.array(list(index.long), object), "pairs": index.pairs}
    for part, values in parts.items():
        _ship(spark, f"{name}-{part}", values)
    return name


def ship_pairs(numbers: DataFrame, count: int) -> tuple[str, ...]:
    """Send a column of about so many numbers of pairs to every machine, as sorted files that
    tasks write to the shared folder; returns their names, in order, for `shipped_index`."""
    spark = numbers.sparkSession
    folder = qualified(spark, fresh_folder(spark, "pair-index"))
    store, base = FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    prefix = f"pairs-{uuid.uuid4().hex}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = sorted_once(np.concatenate([np.empty(0, np.int64), *(b.column(0).to_numpy() for b in batches)]))
        if len(values):
            task = TaskContext.get()
            name = f"{prefix}-{task.partitionId()}-{task.taskAttemptId()}.npy"
            store, base = FileSystem.from_uri(folder)
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                np.save(out, values)
            yield pa.RecordBatch.from_pydict({"first": values[:1], "name": [name]})

    dealt = numbers.repartitionByRange(max(-(-count // FILE_PAIRS), 1), numbers.columns[0])
    written = sorted(dealt.mapInArrow(write, "first long, name string").collect())
    for row in written:
        spark.sparkContext.addFile(f"{folder}/{row.name}")
    return tuple(row.name for row in written)


def ship_counts(words: DataFrame, name: str) -> None:
    """Send the `n` of each word (term, n) of a shipped index, in the order of their numbers."""
    index = shipped_index(name)
    counts = np.zeros(index.size, np.int64)
    for batch in words.select("term", "n").where("term is not null").toArrow().to_batches():
        counts[index.ids(batch["term"])] = batch["n"].to_numpy()
    _ship(words.sparkSession, f"{name}-counts", counts)


def _mapped(name: str) -> np.ndarray:
    return np.load(SparkFiles.get(f"{name}.npy"), mmap_mode="r")


@lru_cache(maxsize=4)
def shipped_index(name: str, pair_files: tuple[str, ...] | None = None) -> TermIndex:
    """The index in a worker; the arrays stay on disk and are mapped. Its pairs are those that
    were sent with it, unless files of `ship_pairs` are named."""
    long_terms = np.load(SparkFiles.get(f"{name}-long.npy"), allow_pickle=True).tolist()
    if pair_files is None:
        pairs = _mapped(f"{name}-pairs")
    else:
        pairs = [_mapped(file.removesuffix(".npy")) for file in pair_files]
    return TermIndex(_mapped(f"{name}-terms"), long_terms, pairs)


@lru_cache(maxsize=4)
def shipped_counts(name: str) -> np.ndarray:
    return _mapped(f"{name}-counts")
