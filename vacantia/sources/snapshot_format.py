"""Snapshot files as a data source: `format("snapshots")` for batches, streams and writes.

A folder holds one gzip file per snapshot, named like one; other names are ignored. Rows are
(source_file, line_no, raw). A gzip file can only be read from its start, also where it has
several members, so one task reads it; small files share a task. A file that can't be unpacked
to its end is an error, or its whole snapshot is left out (`damaged` = `skip`): its task
unpacks it once before it gives any line.

Files are opened with pyarrow, so the folder's URI must be of a kind that it knows (local disk,
HDFS, S3, GCS). `scan_snapshots` reads through Spark's own text reader instead.
"""

from __future__ import annotations

import gzip
import io
import json
import posixpath
import sys
import uuid
import zlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from fnmatch import fnmatchcase

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    InputPartition,
    WriterCommitMessage,
)

from vacantia import constants as C
from vacantia.functions.text import flatten_lines
from vacantia.sources.commit_log import qualified

ROWS = "source_file string, line_no bigint, raw string"
# Compressed bytes that share a task, and the size of a batch of lines.
TASK_BYTES = 8 << 20
BATCH_LINES, BATCH_CHARS = 8192, 4 << 20
DAMAGE = (EOFError, gzip.BadGzipFile, zlib.error)


@dataclass(frozen=True)
class SnapshotFile:
    name: str
    path: str
    length: int
    modified: int  # nanoseconds


@dataclass
class Files(InputPartition):
    files: Sequence[SnapshotFile]


@dataclass
class Written(WriterCommitMessage):
    names: list[tuple[str, str]]  # draft and final path


def list_files(folder: str, glob: str = C.SNAPSHOT_GLOB) -> list[SnapshotFile]:
    store, base = pafs.FileSystem.from_uri(folder)
    found = [
        SnapshotFile(info.base_name, info.path, info.size, info.mtime_ns or 0)
        for info in store.get_file_info(pafs.FileSelector(base))
        if info.type == pafs.FileType.File and fnmatchcase(info.base_name, glob)
    ]
    return sorted(found, key=lambda file: file.name)


def in_tasks(files: Sequence[SnapshotFile]) -> list[Files]:
    tasks: list[list[SnapshotFile]] = []
    size = TASK_BYTES
    for file in files:
        if size + file.length > TASK_BYTES:
            tasks.append([])
            size = 0
        tasks[-1].append(file)
        size += file.length
    return [Files(task) for task in tasks]


def is_damaged(stream) -> bool:
    """Whether a gzip stream can't be read to its end."""
    try:
        with gzip.open(stream) as unpacked:
            while unpacked.read(1 << 20):
                pass
        return False
    except DAMAGE:
        return True


def lines_of(stream) -> Iterator[str]:
    """Lines of a gzip stream without their ends."""
    with gzip.open(stream) as unpacked:
        for line in io.TextIOWrapper(unpacked, "utf-8", errors="replace"):
            yield line.removesuffix("\n")


class _Reading:
    """What batches and streams share: turning files into rows."""

    def __init__(self, options: dict):
        self.folder = options["path"]
        self.glob = options.get("glob", C.SNAPSHOT_GLOB)
        self.damaged = options.get("damaged", "fail")
        if self.damaged not in ("fail", "skip"):
            raise ValueError("damaged is fail or skip")

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(self.folder)
        for file in partition.files:
            if self.damaged == "skip":
                with store.open_input_stream(file.path, compression=None) as stream:
                    if is_damaged(stream):
                        continue
            with store.open_input_stream(file.path, compression=None) as stream:
                yield from self._batches(file.name, lines_of(stream))

    def _batches(self, name: str, lines: Iterator[str]) -> Iterator[pa.RecordBatch]:
        first, held, chars = 1, [], 0
        for line in lines:
            held.append(line)
            chars += len(line)
            if len(held) == BATCH_LINES or chars >= BATCH_CHARS:
                yield self._batch(name, first, held)
                first, held, chars = first + len(held), [], 0
        if held:
            yield self._batch(name, first, held)

    @staticmethod
    def _batch(name: str, first: int, lines: list[str]) -> pa.RecordBatch:
        columns = {
            "source_file": pa.array([name] * len(lines), pa.string()),
            "line_no": pa.array(range(first, first + len(lines)), pa.int64()),
            "raw": pa.array(lines, pa.string()),
        }
        return pa.RecordBatch.from_pydict(columns)


class SnapshotReader(_Reading, DataSourceReader):
    def partitions(self) -> Sequence[Files]:
        return in_tasks(list_files(self.folder, self.glob)) or [Files([])]


class SnapshotStreamReader(_Reading, DataSourceStreamReader):
    """New files as they arrive. An offset is a number of lists of files, which are kept in the
    folder `seen`; what a list has is never looked for again, whenever a file was last changed.
    A list is written before its offset is given out, so a restart finds the same files."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.store, self.lists = pafs.FileSystem.from_uri(options["seen"])
        self.known: set[tuple[str, int, int]] = set()
        self.version = 0

    def _list_path(self, version: int) -> str:
        return posixpath.join(self.lists, f"{version:012d}.json")

    def _read_list(self, version: int) -> list[SnapshotFile]:
        with self.store.open_input_stream(self._list_path(version)) as stream:
            return [SnapshotFile(*row) for row in json.loads(stream.read())]

    def _catch_up(self) -> None:
        while self.store.get_file_info(self._list_path(self.version + 1)).type == pafs.FileType.File:
            self.version += 1
            self.known |= {(f.name, f.length, f.modified) for f in self._read_list(self.version)}

    def initialOffset(self) -> dict:
        return {"lists": 0}

    def latestOffset(self) -> dict:
        self.store.create_dir(self.lists, recursive=True)
        self._catch_up()
        new = [
            file
            for file in list_files(self.folder, self.glob)
            if (file.name, file.length, file.modified) not in self.known
        ]
        if new:
            draft = posixpath.join(self.lists, f".draft-{uuid.uuid4().hex}")
            with self.store.open_output_stream(draft) as out:
                out.write(json.dumps([[f.name, f.path, f.length, f.modified] for f in new]).encode())
            self.store.move(draft, self._list_path(self.version + 1))
            self._catch_up()
        return {"lists": self.version}

    def partitions(self, start: dict, end: dict) -> Sequence[Files]:
        lists = range(start["lists"] + 1, end["lists"] + 1)
        return in_tasks([file for version in lists for file in self._read_list(version)])


class SnapshotWriter(DataSourceArrowWriter):
    """One gzip file per snapshot. Rows (source_file, raw) of a snapshot must be in one task and
    in order. Files get their names when all tasks are done."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder = options["path"]
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = pafs.FileSystem.from_uri(self.folder)
        store.create_dir(base, recursive=True)
        names: list[tuple[str, str]] = []
        current, stream, out = None, None, None
        for batch in iterator:
            for name, raw in zip(*(batch.column(c).to_pylist() for c in ("source_file", "raw"))):
                if name != current:
                    if out is not None:
                        out.close()
                        stream.close()
                    draft = posixpath.join(base, f".{name}-{uuid.uuid4().hex}")
                    stream = store.open_output_stream(draft, compression=None)
                    out = gzip.GzipFile(fileobj=stream, mode="wb", filename="", mtime=0)
                    names.append((draft, posixpath.join(base, name)))
                    current = name
                out.write(f"{raw or ''}\n".encode())
        if out is not None:
            out.close()
            stream.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = pafs.FileSystem.from_uri(self.folder)
        names = [pair for message in messages if message for pair in message.names]
        finals = [final for _, final in names]
        if len(set(finals)) < len(finals):
            raise ValueError("the rows of a snapshot came in several tasks, or not together")
        taken = {file.path for file in list_files(self.folder)}
        if not self.overwrite and taken & set(finals):
            raise ValueError("a snapshot of that name is there already")
        for draft, final in names:
            store.move(draft, final)
        if self.overwrite:
            for path in taken - set(finals):
                store.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = pafs.FileSystem.from_uri(self.folder)
        for message in messages:
            for draft, _ in message.names if message else []:
                store.delete_file(draft)


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)

    def streamReader(self, schema) -> SnapshotStreamReader:
        return SnapshotStreamReader(self.options)

    def writer(self, schema, overwrite: bool) -> SnapshotWriter:
        return SnapshotWriter(self.options, overwrite)


@contextmanager
def by_value() -> Iterator[None]:
    """Send what is of this package with all it uses instead of by name: the process that plans
    a stream doesn't get the packages that workers get."""
    package = sys.modules[__name__.partition(".")[0]]
    cloudpickle.register_pickle_by_value(package)
    try:
        yield
    finally:
        cloudpickle.unregister_pickle_by_value(package)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    with by_value():
        spark.dataSource.register(SnapshotSource)


def read_snapshot_files(
    spark: SparkSession, folder: str, glob: str = C.SNAPSHOT_GLOB, skip_damaged: bool = False
) -> DataFrame:
    """All lines of a flat folder's snapshots: (source_file, line_no, raw)."""
    register(spark)
    return (
        spark.read.format("snapshots")
        .option("glob", glob)
        .option("damaged", "skip" if skip_damaged else "fail")
        .load(qualified(spark, folder))
    )


def stream_snapshot_files(
    spark: SparkSession,
    folder: str,
    seen: str,
    glob: str = C.SNAPSHOT_GLOB,
    skip_damaged: bool = False,
) -> DataFrame:
    """The same for files as they arrive; `seen` is a folder of the stream's own, which lasts as
    long as its checkpoint."""
    register(spark)
    return (
        spark.readStream.format("snapshots")
        .option("glob", glob)
        .option("damaged", "skip" if skip_damaged else "fail")
        .option("seen", qualified(spark, seen))
        .load(qualified(spark, folder))
    )


def write_snapshot_files(lines: DataFrame, folder: str, mode: str = "append") -> None:
    """Write one gzip file per snapshot into a flat folder, lines in order. A file is written by
    one task; `write_snapshots` splits large snapshots over many."""
    spark = lines.sparkSession
    register(spark)
    (
        lines.repartition("source_file")
        .sortWithinPartitions("source_file", "line_no")
        .select("source_file", flatten_lines(F.col("raw")).alias("raw"))
        .write.format("snapshots")
        .mode(mode)
        .save(qualified(spark, folder))
    )
