"""A ledger of the snapshot files of a folder, so that a run opens only what changed.

A row says of one file as it was seen: name, length, time, checksum, whether it could be read,
and what the content gate needs. Rows are added in versions through a commit log; the last row
of a name holds. A file whose length and time are those of its row is not opened again.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.scratch import stage
from vacantia.sources import commit_log
from vacantia.sources.commit_log import qualified
from vacantia.sources.snapshot_format import DAMAGE, lines_of, list_files
from vacantia.sources.snapshots import ends_in_date

LISTED = "source_file string, path string, length long, modified long"
INSPECTED = f"{LISTED}, checksum string, damaged boolean, lines long, head array<string>"
ROWS = (
    "source_file string, length long, modified long, checksum string, damaged boolean, "
    "lines long, lines_checked long, lines_dated long, change string"
)


class _Summed:
    """A stream that takes the checksum of what is read from it."""

    def __init__(self, stream):
        self.stream, self.sum = stream, hashlib.sha256()

    def read(self, size: int = -1) -> bytes:
        data = self.stream.read(size) if size >= 0 else self.stream.read()
        self.sum.update(data)
        return data

    def rest(self) -> str:
        while self.read(1 << 20):
            pass
        return self.sum.hexdigest()


def _inspect_file(store: pafs.FileSystem, path: str, head: int) -> tuple:
    """(checksum, damaged, lines, first lines) in one pass over the file."""
    with store.open_input_stream(path, compression=None) as stream:
        summed, first, count, damaged = _Summed(stream), [], 0, False
        try:
            lines = lines_of(summed)
            first = list(islice(lines, head))
            count = len(first) + sum(1 for _ in lines)
        except DAMAGE:
            damaged, first, count = True, [], 0
        return summed.rest(), damaged, count, first


def inspect_files(files: DataFrame, folder: str, head: int = C.GATE_LINES) -> DataFrame:
    """Open each listed file once: checksum, damage, number of lines, first lines."""
    names = [part.split()[0] for part in INSPECTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows = [(*row, *_inspect_file(store, row[1], head)) for row in zip(*batch.to_pydict().values())]
            columns = [pa.array(list(column)) for column in zip(*rows)] if rows else []
            if columns:
                columns[-1] = columns[-1].cast(pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names)

    return files.select("source_file", "path", "length", "modified").mapInArrow(run, INSPECTED)


def listed_files(spark: SparkSession, folder: str, glob: str = C.SNAPSHOT_GLOB) -> DataFrame:
    """The files of a folder, from the listing alone."""
    files = list_files(qualified(spark, folder), glob)
    return spark.createDataFrame([(f.name, f.path, f.length, f.modified) for f in files], LISTED)


def read_ledger(spark: SparkSession, ledger: str, version: int | None = None) -> DataFrame:
    """The last row of each file, up to a version of the ledger if given."""
    log = commit_log.read_log(
        spark, os.path.join(ledger, "log"), "version long, rows string", version
    )
    entries = {row["rows"]: row["version"] for row in log.select("version", "rows").collect()}
    if not entries:
        return spark.createDataFrame([], ROWS)
    stored = spark.read.schema(f"{ROWS}, rows string").parquet(os.path.join(ledger, "rows"))
    versions = spark.createDataFrame(list(entries.items()), "rows string, version long")
    newest = Window.partitionBy("source_file").orderBy(F.desc("version"))
    return (
        stored.join(F.broadcast(versions), "rows")
        .withColumn("_place", F.row_number().over(newest))
        .filter("_place = 1")
        .drop("_place", "rows", "version")
    )


def update_ledger(
    spark: SparkSession,
    folder: str,
    ledger: str,
    glob: str = C.SNAPSHOT_GLOB,
    n: int = C.GATE_LINES,
    pattern: str = C.DATED_LINE_PATTERN,
) -> DataFrame:
    """Inspect the files that are new or changed, add their rows, and return those rows; `change`
    is `new`, `changed`, or `touched` if the content is as before."""
    listed = listed_files(spark, folder, glob)
    known = read_ledger(spark, ledger).select(
        "source_file",
        F.col("length").alias("_length"),
        F.col("modified").alias("_modified"),
        F.col("checksum").alias("_checksum"),
    )
    compared = listed.join(known, "source_file", "left")
    same = (F.col("length") == F.col("_length")) & (F.col("modified") == F.col("_modified"))
    open_ = stage(compared.filter(~F.coalesce(same, F.lit(False))), "to-inspect")
    if open_.isEmpty():
        return spark.createDataFrame([], ROWS)
    # A file is the unit of work here, so each has a task of its own.
    inspected = inspect_files(open_.repartition(open_.count()), qualified(spark, folder), n)
    change = (
        F.when(F.col("_checksum").isNull(), F.lit("new"))
        .when(F.col("_checksum") == F.col("checksum"), F.lit("touched"))
        .otherwise(F.lit("changed"))
    )
    rows = inspected.join(open_.select("source_file", "_checksum"), "source_file").select(
        "source_file", "length", "modified", "checksum", "damaged", "lines",
        F.size("head").cast("bigint").alias("lines_checked"),
        F.size(F.filter("head", lambda line: ends_in_date(line, pattern)))
        .cast("bigint").alias("lines_dated"),
        change.alias("change"),
    )
    name = uuid.uuid4().hex
    written = os.path.join(ledger, "rows", f"rows={name}")
    rows.write.parquet(written)
    commit_log.append(spark, os.path.join(ledger, "log"), lambda version, before: {"rows": name})
    return spark.read.schema(ROWS).parquet(written)


def ledger_gate(ledger: DataFrame, n: int = C.GATE_LINES) -> DataFrame:
    """The content gate's result for each readable file of the ledger that has a line."""
    valid = (F.col("lines_checked") == n) & (F.col("lines_dated") == n)
    return ledger.filter(~F.col("damaged") & (F.col("lines") > 0)).select(
        "source_file", "lines_checked", "lines_dated", valid.alias("valid")
    )


def processed_dates(manifest: DataFrame) -> DataFrame:
    """(snapshot_date) that the valid snapshots of a manifest are named after."""
    named = F.regexp_extract("source_file", r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    dates = manifest.filter("status = 'valid'").select(named.alias("snapshot_date"))
    return dates.filter(F.col("snapshot_date").isNotNull()).distinct()
