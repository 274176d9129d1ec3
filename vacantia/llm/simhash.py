"""Near-duplicates by SimHash, searched with BK-trees.

Every text gets a 64-bit fingerprint; fingerprints that differ in at most `RADIUS` bits are
linked. The 64 bits are cut into five blocks. Two fingerprints that differ in three bits
agree on two blocks at least, so each pair of blocks is a table of shards, and every link
lies inside a shard. A shard's distinct fingerprints form a BK-tree: a child hangs on its
parent by their integer Hamming distance, and a search follows only edges within the radius
of the distance to the parent. A shard of over `TREE_SIZE` fingerprints becomes several
trees, each searched with each part of the shard, so no task holds more than two parts.

The trees reach their searches by shuffle, not by a broadcast from the driver: together
they are as large as the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import map_batches, strings
from vacantia.llm.components import connected_components
from vacantia.scratch import stage

# --- fixed values: the fingerprint ---
SHINGLE_WORDS = 3
HASH_SEED = 42
RADIUS = 3
# --- end of fixed values ---
BLOCK_BITS = (13, 13, 13, 13, 12)
TREE_SIZE = 4096
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; without a word, zero."""
    words = text.encode().lower().split()
    if not words:
        return 0
    parts = [words[i:] for i in range(SHINGLE_WORDS)] if len(words) >= SHINGLE_WORDS else [words]
    shingles = map(b" ".join, zip(*parts)) if len(parts) > 1 else iter([b" ".join(words)])
    ones, total = np.zeros(64, np.int64), 0
    while some := [xxhash.xxh64_intdigest(s, HASH_SEED) for s in islice(shingles, HASHES_AT_ONCE)]:
        octets = np.array(some, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        total += len(some)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, print (the 64 bits as a signed long). Null text: empty."""

    def make(batch: pa.RecordBatch) -> dict:
        return {
            "doc_id": batch.column("doc_id"),
            "print": [fingerprint(text) for text in strings(batch, "text")],
        }

    return map_batches(documents.select("doc_id", "text"), "doc_id long, print long", make)


class BKTree:
    """Integers under Hamming distance; children are keyed by their distance to the parent."""

    def __init__(self, values: list[int]):
        self.values = values
        self.children: list[dict[int, int]] = [{} for _ in values]
        for i, value in enumerate(values[1:], 1):
            at = 0
            while True:
                distance = (value ^ values[at]).bit_count()
                below = self.children[at].get(distance)
                if below is None:
                    self.children[at][distance] = i
                    break
                at = below

    def near(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """For each node met: its place and the places of the queries within the radius of it.
        All queries go down together; at an edge only those go on that can have a match."""
        if not self.values:
            return
        waiting = [(0, np.arange(len(queries)))]
        while waiting:
            at, asked = waiting.pop()
            distances = np.bitwise_count(queries[asked] ^ np.uint64(self.values[at])).astype(int)
            found = asked[distances <= radius]
            if len(found):
                yield at, found
            for edge, below in self.children[at].items():
                follow = asked[np.abs(distances - edge) <= radius]
                if len(follow):
                    waiting.append((below, follow))


def _forest(prints: np.ndarray, nodes: np.ndarray, parts: np.ndarray, radius: int) -> list:
    """Links that join whatever the shard's links join, without listing them all."""
    first = parts == parts[0]
    tree_at = np.flatnonzero(first)
    asked_at = tree_at if first.all() else np.flatnonzero(~first)
    tree = BKTree(prints[tree_at].tolist())
    label, links = np.arange(len(prints)), []
    for at, found in tree.near(prints[asked_at], radius):
        at, found = tree_at[at], asked_at[found]
        groups = label[found]
        if (groups == label[at]).all():
            continue
        for group in np.unique(groups):
            if group != label[at]:
                links.append((nodes[at], nodes[found[np.argmax(groups == group)]]))
                label[label == group] = label[at]
    return links


def _shard_links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard; a shard may reach over batches."""
    keys = ["table", "key", "left", "right"]
    rest: pa.Table | None = None

    def links(rows: pa.Table, bounds: np.ndarray) -> pa.RecordBatch:
        prints = rows.column("print").to_numpy().view(np.uint64)
        nodes, parts = rows.column("node").to_numpy(), rows.column("part").to_numpy()
        found = []
        for a, b in zip(bounds[:-1], bounds[1:]):
            found += _forest(prints[a:b], nodes[a:b], parts[a:b], radius)
        ends = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
        columns = [rows.column(k).to_numpy() for k in keys]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        bounds = np.concatenate([[0], np.flatnonzero(new) + 1])
        if len(bounds) > 1:
            yield links(rows, bounds)
        rest = rows.slice(bounds[-1])
    if rest is not None:
        yield links(rest, np.array([0, rest.num_rows]))


def _masks() -> list[int]:
    """The bits of each pair of blocks, as signed longs."""
    blocks, at = [], 0
    for width in BLOCK_BITS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    pairs = [a | b for a, b in combinations(blocks, len(BLOCK_BITS) - RADIUS)]
    return [mask - (1 << 64) if mask >> 63 else mask for mask in pairs]


def links(classes: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """(node, print), prints distinct -> links (a, b) with the components of all links of at
    most RADIUS bits."""
    keyed = classes.select(
        "node",
        "print",
        F.explode(F.array(*[
            F.struct(F.lit(t).alias("table"), F.col("print").bitwiseAND(F.lit(mask)).alias("key"))
            for t, mask in enumerate(_masks())
        ])).alias("shard"),
    ).select("shard.table", "shard.key", "node", "print")
    sizes = keyed.groupBy("table", "key").agg(F.count("*").alias("size")).where("size > 1")
    parts = F.ceil(F.col("size") / F.lit(tree_size)).cast("int")
    shards = (
        keyed.join(sizes, ["table", "key"])
        .withColumn("parts", parts)
        .withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(
            "table", "key",
            F.least("part", "other").alias("left"), F.greatest("part", "other").alias("right"),
            "part", "node", "print",
        )
        .repartition("table", "key", "left", "right")
        .sortWithinPartitions("table", "key", "left", "right", "part")
    )
    return shards.mapInArrow(lambda batches: _shard_links(batches, RADIUS), "a long, b long")


def near_duplicates(documents: DataFrame, tree_size: int = TREE_SIZE) -> DataFrame:
    """doc_id, print, component_id: the smallest doc_id reachable over links, itself included.

    Equal fingerprints are one class, so copies meet in a count, not in pairs. Empty and
    null texts have fingerprint zero and are linked like any other. A row without doc_id
    takes its class's component, null if the class has no id. Repeated rows are returned
    as often as they come; other columns are not read.
    """
    prints = stage(fingerprints(documents), "prints")
    classes = stage(
        prints.where(F.col("doc_id").isNotNull())
        .groupBy("print")
        .agg(F.min("doc_id").alias("node")),
        "classes",
    )
    components = connected_components(links(classes, tree_size))
    rooted = classes.join(components, "node", "left").select(
        "print", F.coalesce("component_id", "node").alias("component_id")
    )
    return prints.join(rooted, "print", "left").select("doc_id", "print", "component_id")
