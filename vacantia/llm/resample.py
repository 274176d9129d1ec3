"""Importance resampling of documents towards a target text, on hashed word features.

Runs of words become features, their CRC-32 a bucket. The log ratio of a bucket's share in the
target and in the corpus is its gain; a document's weight is its mean gain. Gumbel noise from a
hash of the id and a seed turns the highest scores into a draw without replacement.

CRCs are worked out for all distinct features of many texts together: features of one length
form a matrix of bytes, whose columns update all CRCs of that length at once; the buckets are
scattered back to the places of the features.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count as count_up

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import map_batches
from vacantia.operators.ranking import add_position
from vacantia.scratch import stage

# --- fixed values: buckets, words of a feature, words of a drawable document, seed, share ---
BUCKETS = 10_000
LONGEST_RUN = 2
LEAST_WORDS = 20
SEED = 7
PERCENT = 25
# --- end of fixed values ---
# Words worked on together, and bytes of one text cut into words at once.
WORDS_AT_ONCE = 100_000
SLICE_BYTES = 1 << 20

_POLYNOMIAL = 0xEDB88320
# Letters, digits and all bytes of other characters stay, A-Z in lower case; the rest separates.
_WORD_BYTES = bytes(
    ord(chr(b).lower()) if chr(b).isalnum() and b < 128 else b if b >= 128 else 0x20
    for b in range(256)
)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(_POLYNOMIAL), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()


def matrix_crcs(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional array of bytes, column by column."""
    crcs = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crcs = np.take(_CRC, crcs.astype(np.uint8) ^ column) ^ (crcs >> 8)
    return ~crcs


def crcs_by_length(features: list[bytes]) -> np.ndarray:
    """CRC-32 of each feature: one matrix for each length."""
    lengths = np.fromiter(map(len, features), np.int64, len(features))
    order = np.argsort(lengths, kind="stable")
    octets = np.frombuffer(b"".join(map(features.__getitem__, order.tolist())), np.uint8)
    crcs = np.empty(len(features), np.uint32)
    sizes, counts = np.unique(lengths, return_counts=True)
    at = place = 0
    for size, count in zip(sizes.tolist(), counts.tolist()):
        rows = octets[at : at + size * count].reshape(count, size)
        crcs[order[place : place + count]] = matrix_crcs(rows)
        at, place = at + size * count, place + count
    return crcs


def _slices(octets: bytes) -> Iterator[bytes]:
    """A text's words in slices of bounded size; a word is never cut."""
    start = 0
    while len(octets) - start > SLICE_BYTES:
        end = octets.find(b" ", start + SLICE_BYTES)
        if end < 0:
            break
        yield octets[start:end]
        start = end
    yield octets[start:]


def _word_groups(texts: list[bytes | None]) -> Iterator[tuple[list[bytes], list[int], list[int]]]:
    """Some words at a time: the words, the text of each part, and the part's end among them."""
    words: list[bytes] = []
    owners: list[int] = []
    ends: list[int] = []
    for i, text in enumerate(texts):
        for part in _slices((text or b"").translate(_WORD_BYTES)):
            words += part.split()
            owners.append(i)
            ends.append(len(words))
            if len(words) >= WORDS_AT_ONCE:
                yield words, owners, ends
                words, owners, ends = [], [], []
    if owners:
        yield words, owners, ends


def feature_buckets(
    texts: list[bytes | None], buckets: int = BUCKETS
) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(text of each feature, bucket of each feature, number of words) for some words at a time."""
    last_owner, last_word = -1, b""
    for words, owners, ends in _word_groups(texts):
        owner = np.repeat(owners, np.diff(ends, prepend=0))
        count = len(words)
        if not count:
            continue
        # The word before these, if it is of the same text, starts one more pair.
        if last_owner == owner[0]:
            words = [last_word, *words]
            owner = np.concatenate([owner[:1], owner])
        index: dict[bytes, int] = defaultdict(count_up().__next__)
        ids = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
        known = list(index)
        inside = owner[1:] == owner[:-1]
        pairs, at = np.unique((ids[:-1] * len(known) + ids[1:])[inside], return_inverse=True)
        first, second = np.divmod(pairs, len(known))
        named = (map(known.__getitem__, ids.tolist()) for ids in (first, second))
        features = [*known, *map(b" ".join, zip(*named))]
        bucket = (crcs_by_length(features) % buckets).astype(np.int64)
        yield (
            np.concatenate([owner[-count:], owner[1:][inside]]),
            np.concatenate([bucket[ids[-count:]], bucket[len(known) :][at]]),
            count,
        )
        last_owner, last_word = int(owner[-1]), words[-1]


def _octets(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def bucket_counts(documents: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts are in each bucket that has any."""

    def make(batch: pa.RecordBatch) -> dict:
        total = np.zeros(buckets, np.int64)
        for _, bucket, _ in feature_buckets(_octets(batch), buckets):
            total += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(total)
        return {"bucket": held, "n": total[held]}

    counts = map_batches(documents.select("text"), "bucket int, n long", make)
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Each bucket's gain, a thousand times the log ratio of its smoothed shares, rounded down.
    The driver gets two numbers a bucket, whatever the size of the tables."""
    spark = corpus.sparkSession
    s, t = F.coalesce("s.n", F.lit(0)), F.coalesce("t.n", F.lit(0))
    counted = (
        spark.range(buckets).select(F.col("id").cast("int").alias("bucket"))
        .join(bucket_counts(corpus, buckets).alias("s"), "bucket", "left")
        .join(bucket_counts(target, buckets).alias("t"), "bucket", "left")
        .select("bucket", s.alias("s"), t.alias("t"))
        .toPandas()
        .sort_values("bucket")
    )
    of_corpus, of_target = (counted[k].to_numpy().astype(float) for k in ("s", "t"))
    all_corpus, all_target = of_corpus.sum() + buckets, of_target.sum() + buckets
    ratio = (of_target + 1) * all_corpus / ((of_corpus + 1) * all_target)
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(documents: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of each row: the mean gain of its features, rounded
    down; 0 without features."""

    def make(batch: pa.RecordBatch) -> dict:
        texts = _octets(batch)
        total, features, words = (np.zeros(len(texts), np.int64) for _ in range(3))
        for owner, bucket, count in feature_buckets(texts, len(gains)):
            features += np.bincount(owner, minlength=len(texts))
            words += np.bincount(owner[:count], minlength=len(texts))
            np.add.at(total, owner, gains[bucket])
        return {
            "doc_id": batch.column("doc_id"),
            "n_words": words,
            "n_features": features,
            "weight": total // np.maximum(features, 1),
        }

    schema = "doc_id long, n_words long, n_features long, weight long"
    return map_batches(documents.select("doc_id", "text"), schema, make)


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times standard Gumbel noise from a hash of the id, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("bigint")
    uniform = (h + 0.5) / F.lit(4294967296.0)
    return F.floor(-1000 * F.log(-F.log(uniform)))


def resample(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank, one row per row of `documents`. Of the
    rows with 20 words or more, the given percentage with the highest scores is drawn; `rank`
    is a drawn row's place from 1, by falling score, then id, else null.

    Null texts have no words. Rows without doc_id get the noise of an empty id and come after
    others of their score. Repeated rows are drawn each by itself, in any order. Empty tables
    count as no features. Other columns are not read. The texts are read twice and never move;
    what moves is a row of numbers per document.
    """
    gains = bucket_gains(documents, target)
    scored = weigh(documents, gains).withColumn(
        "score", F.col("weight") + gumbel(F.col("doc_id"), seed)
    )
    scored = stage(scored, "scored")
    able = F.col("n_words") >= LEAST_WORDS
    drawn = percent * scored.where(able).count() // 100
    placed = add_position(
        scored.where(able), "rank", F.desc("score"), F.asc_nulls_last("doc_id")
    )
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    return placed.withColumn("rank", rank).unionByName(
        scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    )
