"""A Bloom filter of a set of words, for sets too large to broadcast as they are."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One part of the bits, as Spark's bitmap functions hold it.
PART_BITS = 1 << 15
# The filter is broadcast, so its size has a bound: 32 MB. Beyond it more words pass that are
# not in the set, and an exact join after the filter still drops them.
MOST_BITS = 1 << 28
BITS_PER_WORD = 12
# Each place is taken from other bits of one 64-bit hash.
SHIFTS = (0, 18, 36)


def filter_bits(words: int) -> int:
    """A power of two with enough bits for so many words, within the bound."""
    return min(MOST_BITS, max(PART_BITS, 1 << (BITS_PER_WORD * max(words, 1) - 1).bit_length()))


def _bitmap(words: DataFrame, hashed: Column, bits: int) -> np.ndarray:
    """The filter's bytes. Bits are set on the executors, part by part; the driver gets at most
    `bits / PART_BITS` parts of 4 KB."""
    places = F.array(*[F.shiftrightunsigned(hashed, s).bitwiseAND(bits - 1) for s in SHIFTS])
    parts = (
        words.select(F.explode(places).alias("place"))
        .groupBy(F.shiftright("place", 15).alias("part"))
        .agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(PART_BITS - 1)).alias("bits"))
    )
    bitmap = np.zeros((bits // PART_BITS, PART_BITS // 8), np.uint8)
    for part, octets in parts.toLocalIterator():
        bitmap[part] = np.frombuffer(octets, np.uint8)
    return bitmap.ravel()


class WordFilter:
    """May say of a word outside the set that it is in it, never the reverse. Words are the
    column `term`, unless other 64-bit hashes are given."""

    def __init__(self, words: DataFrame, count: int, hashed: Column | None = None):
        self._bits = filter_bits(count)
        hashed = F.xxhash64("term") if hashed is None else hashed
        bitmap = _bitmap(words, hashed, self._bits)
        self._shared = words.sparkSession.sparkContext.broadcast(bitmap)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """For tasks: whether words of these hashes may be in the set."""
        bitmap, values = self._shared.value, hashes.view(np.uint64)
        held = np.ones(len(values), bool)
        for shift in SHIFTS:
            places = (values >> np.uint64(shift)) & np.uint64(self._bits - 1)
            held &= (bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return held

    def may_hold(self, word: Column) -> Column:
        def test(hashes: pa.Array) -> pa.Array:
            return pa.array(self.holds(hashes.to_numpy(zero_copy_only=False)))

        return F.arrow_udf(test, "boolean")(F.xxhash64(word))
