"""Packing token sequences by minimum bin slack.

Documents become pieces of at most `capacity` tokens. Which lengths share a window is
decided on the counts of lengths alone, `capacity` numbers whatever the corpus: the longest
remaining length opens a window, a bitset subset-sum picks the multiset of remaining lengths
that fills the rest closest to capacity, and the pattern is repeated as often as the counts
allow. Pieces then find their window by their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vacantia.llm.common import map_batches, strings
from vacantia.llm.tokens import ByteLevelTokens, loaded
from vacantia.scratch import stage

# --- fixed values: the sequence format ---
CAPACITY = 1024
END_ID = 0
# --- end of fixed values ---
RANK_BUCKETS = 4096


def pieces(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids and the end id, cut
    at multiples of the capacity."""

    def make(batch: pa.RecordBatch) -> dict:
        encode = loaded(ByteLevelTokens, tokenizer_path).encode
        end = np.array([END_ID], "<u4").tobytes()
        made: dict[str, list] = {
            k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        }
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text")):
            ids = memoryview(encode(text) + end)
            total = len(ids) // 4
            for start in range(0, total, capacity):
                length = min(capacity, total - start)
                made["doc_id"].append(doc_id)
                made["start"].append(start)
                made["length"].append(length)
                made["ids_crc32"].append(zlib.crc32(ids[4 * start : 4 * (start + length)]))
                made["doc_tokens"].append(total)
        return made

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    return map_batches(documents.select("doc_id", "text"), schema, make)


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, within their counts, with the largest sum up to `room`.

    Bit s of `sums` says that some choice so far adds up to s. A count is taken in parts of
    1, 2, 4 ... copies; the sums before each part are kept, and going back over them tells
    which parts the best sum needs.
    """
    sums, mask = 1, (1 << (room + 1)) - 1
    parts: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        copies = 1
        while left > 0:
            copies = min(copies, left)
            parts.append((length, copies, sums))
            sums |= (sums << (length * copies)) & mask
            left -= copies
            copies *= 2
        if sums >> room:
            break
    best, chosen = sums.bit_length() - 1, {}
    for length, copies, before in reversed(parts):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + copies
            best -= length * copies
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) and how often each is used, until every count is spent."""
    counts = {length: count for length, count in counts.items() if count > 0}
    patterns = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        rest = {l: c for l, c in counts.items() if 0 < c and l <= capacity - first}
        pattern = best_fill(rest, capacity - first)
        counts[first] += 1
        pattern[first] = pattern.get(first, 0) + 1
        times = min(counts[length] // copies for length, copies in pattern.items())
        patterns.append((pattern, times))
        for length, copies in pattern.items():
            counts[length] -= copies * times
            if not counts[length]:
                del counts[length]
    return patterns


def _windows(patterns: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, ...]:
    """For each length and pattern, sorted: length, first rank, copies, first sequence, offset."""
    rows, taken, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            copies = pattern[length]
            rows.append((length, taken.get(length, 0), copies, sequence, offset))
            taken[length] = taken.get(length, 0) + copies * times
            offset += length * copies
        sequence += times
    return tuple(np.array(sorted(rows), np.int64).reshape(-1, 5).T)


def ranked(cut: DataFrame) -> DataFrame:
    """Add `rank`, from 0, among the pieces of a length.

    One length may hold most pieces, so ranks are taken in hashed buckets and shifted by the
    buckets before; the rows move once, by (length, bucket).
    """
    bucketed = cut.withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(RANK_BUCKETS))
    )
    earlier = (
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("size")).select(
        "length", "bucket", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    return (
        bucketed.withColumn("inside", F.row_number().over(inside) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("inside"))
        .drop("bucket", "before", "inside")
    )


def pack(documents: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are the end id alone. Repeated rows are packed as often as they
    come, rows without doc_id too; their pieces keep the null. Other columns are not read.
    """
    cut = stage(pieces(documents, tokenizer_path, capacity), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    length_of, first, copies, sequence, offset = _windows(plan(counts, capacity))
    # Ranks are below 2^50, so (length, rank) sorts as one integer.
    starts = (length_of << 50) + first

    def make(batch: pa.RecordBatch) -> dict:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        at = np.searchsorted(starts, (length << 50) + rank, side="right") - 1
        inside = rank - first[at]
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
        return {name: batch.column(name) for name in names} | {
            "sequence_id": sequence[at] + inside // copies[at],
            "offset": offset[at] + inside % copies[at] * length,
        }

    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long"
    )
    return map_batches(ranked(cut), schema, make)
