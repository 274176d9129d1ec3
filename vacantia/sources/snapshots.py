"""Dated gzip snapshots of listings: scan, content gate, manifest, sink."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.text import flatten_lines, strip
from vacantia.operators.joins import staged_lookup


UNPACK_BYTES = 1 << 20


def _count_on(files: Iterator[pd.Series]) -> Iterator[pd.Series]:
    seen: dict[int, int] = {}
    for batch in files:
        position = batch.groupby(batch).cumcount() + 1
        yield position + batch.map(lambda f: seen.get(f, 0))
        for file, n in batch.value_counts().items():
            seen[file] = seen.get(file, 0) + int(n)


def _snapshot_files(reader, folder: str | list[str], partitioned: bool) -> DataFrame:
    """Lines with the snapshot they belong to and the physical file they are in."""
    if partitioned:
        files = reader.schema("value string, source_file string").text(folder)
        snapshot = F.col("source_file")
    else:
        files = reader.option("pathGlobFilter", C.SNAPSHOT_GLOB).text(folder)
        snapshot = F.col("_metadata.file_name")
    return files.select(
        snapshot.alias("source_file"),
        F.col("_metadata.file_name").alias("part"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("value").alias("raw"),
    )


def with_part_lines(files: DataFrame) -> DataFrame:
    """Add the position of each line in its physical file.

    A gzip file cannot be split, so one task reads it from start to end and a running
    count is the exact line number, also after a retry. Only a file hash goes to Python.
    Not deterministic as far as the optimiser is concerned: no filter may move below it.
    """
    counter = F.pandas_udf(_count_on, "bigint").asNondeterministic()
    return files.select("source_file", "part", counter(F.xxhash64("_path")).alias("part_line"), "raw")


def join_parts(lines: DataFrame) -> DataFrame:
    """Line numbers of whole snapshots from those of their parts.

    Part names sort in line order, so a part starts after the lines of the earlier ones;
    the running sum sees one row per part.
    """
    sizes = lines.groupBy("source_file", "part").agg(F.max("part_line").alias("_size"))
    earlier = (
        Window.partitionBy("source_file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = sizes.select(
        "source_file", "part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before")
    )
    placed = staged_lookup(lines, before, ["source_file", "part"], spread_by="part_line", how="inner")
    return placed.select(
        "source_file", (F.col("_before") + F.col("part_line")).alias("line_no"), "raw"
    )


def _is_damaged(content: bytes) -> bool:
    """Whether gzip data can't be read to its end; in steps, so only a step is unpacked."""
    data = memoryview(content)
    unpack = zlib.decompressobj(zlib.MAX_WBITS | 16)
    try:
        while len(data):
            if unpack.eof:  # another member follows
                unpack = zlib.decompressobj(zlib.MAX_WBITS | 16)
            unpack.decompress(data[:UNPACK_BYTES], UNPACK_BYTES)
            while unpack.unconsumed_tail:
                unpack.decompress(unpack.unconsumed_tail, UNPACK_BYTES)
            data = data[UNPACK_BYTES:] if not unpack.unused_data else _after(data, unpack)
        return not unpack.eof
    except zlib.error:
        return True


def _after(data: memoryview, unpack) -> memoryview:
    """What follows the member that ended inside the last step."""
    taken = min(len(data), UNPACK_BYTES) - len(unpack.unused_data)
    return data[taken:]


def damaged_snapshots(spark: SparkSession, folder: str, partitioned: bool = False) -> DataFrame:
    """(source_file) of the snapshots with a file that can't be read to its end."""
    reader = spark.read.format("binaryFile")
    if partitioned:
        files = reader.option("pathGlobFilter", "*.gz").load(folder)
    else:
        files = reader.option("pathGlobFilter", C.SNAPSHOT_GLOB).load(folder)
    if not partitioned:
        files = files.withColumn("source_file", F.element_at(F.split("path", "/"), -1))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = batch.column("source_file"), batch.column("content")
            broken = [n.as_py() for n, c in zip(names, contents) if _is_damaged(c.as_buffer())]
            yield pa.RecordBatch.from_arrays([pa.array(broken, pa.string())], ["source_file"])

    return files.select("source_file", "content").mapInArrow(test, "source_file string").distinct()


def scan_snapshots(
    spark: SparkSession, folder: str, partitioned: bool = False, skip_damaged: bool = False
) -> DataFrame:
    """All lines of the snapshots in a folder: (source_file, line_no, raw).

    Reads one file per snapshot, named like one (other names are ignored), or the layout
    of `write_snapshots`. A damaged file is an error; with `skip_damaged` its whole
    snapshot is left out (`damaged_snapshots` names it). The reader's own option to ignore
    such files would keep a part of them and hide read errors, so the files are tested first.
    """
    files = _snapshot_files(spark.read, folder, partitioned)
    if skip_damaged:
        broken = [row[0] for row in damaged_snapshots(spark, folder, partitioned).collect()]
        if partitioned:
            files = files.filter(~F.col("source_file").isin(broken))
        else:
            listed = list_snapshots(spark, folder).filter(~F.col("source_file").isin(broken))
            whole = [row.path for row in listed.select("path").collect()]
            if not whole:
                return spark.createDataFrame([], "source_file string, line_no bigint, raw string")
            files = _snapshot_files(spark.read, whole, partitioned)
    lines = with_part_lines(files)
    if partitioned:
        return join_parts(lines)
    return lines.select("source_file", F.col("part_line").alias("line_no"), "raw")


def stream_snapshots(
    spark: SparkSession, folder: str, partitioned: bool = False, files_per_batch: int | None = None
) -> DataFrame:
    """New snapshot files as a stream, in the same two layouts, with part positions.

    A damaged file fails the stream, as it fails a scan. A limit of files per batch could
    tear the parts of one snapshot apart, so only whole-file snapshots may have one.
    """
    if files_per_batch and partitioned:
        raise ValueError("files_per_batch would split snapshots that have several parts")
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_part_lines(_snapshot_files(reader, folder, partitioned))


def write_snapshots(
    lines: DataFrame, folder: str, mode: str = "overwrite", partitions: int | None = None
) -> None:
    """Write one gzip folder per snapshot, lines in order.

    Range partitions on (source_file, line_no) split a large snapshot over many parts;
    their number adapts to the data unless it is given.
    """
    count = [partitions] if partitions else []
    (
        lines.select("source_file", "line_no", flatten_lines(F.col("raw")).alias("value"))
        .repartitionByRange(*count, "source_file", "line_no")
        .sortWithinPartitions("source_file", "line_no")
        .select("source_file", "value")
        .write.mode(mode)
        .partitionBy("source_file")
        .option("compression", "gzip")
        .text(folder)
    )


def list_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the snapshot files, readable or not; no content is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", C.SNAPSHOT_GLOB).load(folder)
    name = F.element_at(F.split("path", "/"), -1).alias("source_file")
    return files.select(name, "length", "path")


def ends_in_date(raw: Column, pattern: str = C.DATED_LINE_PATTERN) -> Column:
    return strip(raw).rlike(pattern)


def snapshot_gate(lines: DataFrame, n: int = C.GATE_LINES) -> DataFrame:
    """Per file: is each of its first n lines there and is it `dated`?"""
    return (
        lines.filter(F.col("line_no") <= n)
        .groupBy("source_file")
        .agg(F.count("*").alias("lines_checked"), F.count_if("dated").alias("lines_dated"))
        .withColumn("valid", (F.col("lines_checked") == n) & (F.col("lines_dated") == n))
    )


def raw_gate(
    lines: DataFrame, n: int = C.GATE_LINES, pattern: str = C.DATED_LINE_PATTERN
) -> DataFrame:
    """The gate on raw lines."""
    first = lines.filter(F.col("line_no") <= n)
    return snapshot_gate(first.withColumn("dated", ends_in_date(F.col("raw"), pattern)), n)


def snapshot_manifest(
    files: DataFrame, gate: DataFrame, n: int = C.GATE_LINES, damaged: DataFrame | None = None
) -> DataFrame:
    """Status of every listed file, and why it was discarded; `damaged` names the files that
    were left out as such."""
    if damaged is None:
        damaged = files.select("source_file").limit(0)
    flagged = files.select("source_file").join(
        damaged.select("source_file", F.lit(True).alias("damaged")), "source_file", "left"
    )
    reason = (
        F.when(F.col("damaged"), F.lit("damaged"))
        .when(F.col("lines_checked").isNull(), F.lit("no readable line"))
        .when(F.col("lines_checked") < n, F.lit("too few lines"))
        .when(F.col("lines_dated") < n, F.lit("line without date"))
    )
    joined = flagged.join(gate, "source_file", "left")
    return joined.select(
        "source_file",
        F.when(F.col("valid"), F.lit("valid")).otherwise(F.lit("discarded")).alias("status"),
        reason.alias("reason"),
    )


def valid_lines(lines: DataFrame, gate: DataFrame) -> DataFrame:
    """Lines of the files that passed the gate."""
    valid = gate.filter("valid").select("source_file")
    return staged_lookup(lines, valid, "source_file", spread_by="line_no", how="left_semi")


def batch_size_gate(lines: DataFrame, min_rows: int = C.MIN_BATCH_ROWS) -> DataFrame:
    """Lines of the snapshots that have at least `min_rows` lines."""
    large = (
        lines.groupBy("source_file")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") >= min_rows)
        .select("source_file")
    )
    return staged_lookup(lines, large, "source_file", spread_by="line_no", how="left_semi")
