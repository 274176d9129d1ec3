"""Repeated lines across documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import SPACES, free_name, map_batches
from vacantia.scratch import stage

# --- fixed values: which lines count ---
MIN_KEY_CHARS = 10
MIN_DOCUMENTS = 2
# --- end of fixed values ---
_STRIPPED = SPACES.encode()


def line_digests(text: str) -> list[bytes | None]:
    """A 128-bit hash of each line's key, None for a key of too few code points."""
    digests = []
    for line in text.encode().lower().split(b"\n"):
        key = line.strip(_STRIPPED)
        long = len(key) >= MIN_KEY_CHARS and (
            len(key) >= 4 * MIN_KEY_CHARS or len(key.decode()) >= MIN_KEY_CHARS
        )
        digests.append(xxhash.xxh128_digest(key) if long else None)
    return digests


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def document_lines(documents: DataFrame) -> DataFrame:
    """doc_id, h1, h2: each document's keys, once each."""

    def make(batch: pa.RecordBatch) -> dict:
        ids, digests = [], []
        for doc_id, text in zip(
            batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        ):
            own = set(line_digests(text)) - {None} if text else ()
            ids += [doc_id] * len(own)
            digests += own
        h1, h2 = _halves(digests)
        return {"doc_id": ids, "h1": h1, "h2": h2}

    some = documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    return map_batches(some, "doc_id long, h1 long, h2 long", make)


def repeated_lines(lines: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """h1, h2, keeper: keys found in at least so many documents, and the smallest of them.
    Counts combine on the map side, so a line that stands everywhere is one row per task."""
    return (
        lines.groupBy("h1", "h2")
        .agg(
            F.count("*").alias("documents"),
            F.min("doc_id").alias("keeper"),
            F.max("doc_id").alias("last"),
        )
        .where((F.col("documents") >= min_documents) & (F.col("keeper") != F.col("last")))
        .select("h1", "h2", "keeper")
    )


def drop_repeated_lines(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents, all columns, with `text` rebuilt from the lines that stay, in order,
    and the added columns n_lines and n_dropped (before and lost).

    A key found in `min_documents` documents stays in the smallest doc_id that holds it, with
    all its lines there. Null and empty texts are one empty line; null text stays null. Rows
    that share a doc_id are one document when `min_documents` is 2, and are counted one by
    one beyond. A row without doc_id is not counted and loses nothing. Columns that are
    named n_lines or n_dropped already are replaced.

    Only hashes and ids meet by line; the text moves once, by doc_id.
    """
    documents = documents.drop("n_lines", "n_dropped")
    lines = stage(document_lines(documents), "lines")
    # Written, so that the join has a plain shuffle on both sides and may split a line that
    # stands in very many documents.
    repeated = stage(repeated_lines(lines, min_documents), "repeated")
    lost = (
        lines.join(repeated, ["h1", "h2"])
        .where(F.col("doc_id") != F.col("keeper"))
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("h1", "h2")).alias("lost"))
    )
    key, name = free_name(documents, "_lost_doc"), free_name(documents, "_lost")
    lost = lost.select(F.col("doc_id").alias(key), F.col("lost").alias(name))
    joined = documents.join(lost, documents["doc_id"] == lost[key], "left").drop(key)
    columns = [f for f in documents.schema]

    def make(batch: pa.RecordBatch) -> dict:
        texts, n_lines, n_dropped = [], [], []
        for text, lost_keys in zip(batch.column("text").to_pylist(), batch.column(name).to_pylist()):
            rows = (text or "").split("\n")
            kept = rows
            if lost_keys:
                gone = {
                    np.array([k["h1"], k["h2"]], "<i8").tobytes() for k in lost_keys
                }
                digests = line_digests(text)
                kept = [row for row, digest in zip(rows, digests) if digest not in gone]
            texts.append(text if text is None else "\n".join(kept))
            n_lines.append(len(rows))
            n_dropped.append(len(rows) - len(kept))
        made = {f.name: batch.column(f.name) for f in columns if f.name != "text"}
        return made | {"text": texts, "n_lines": n_lines, "n_dropped": n_dropped}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    return map_batches(joined, f"{schema}, n_lines long, n_dropped long", make)
