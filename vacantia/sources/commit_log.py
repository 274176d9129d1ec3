"""A log of numbered entries in a folder, for several writers at a time.

An entry is one JSON file, named by its version. Writers put the version after the last one;
only one of them can, and the others learn of it and try the next. So entries are in one order,
and what an entry says holds for every entry before it. Readers see whole entries or none.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

DIGITS = 20
MAX_TRIES = 100


class Conflict(RuntimeError):
    """An entry that another writer made in between leaves no room for this one."""


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system for a path, and the path on it."""
    context = spark.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(context._jsc.hadoopConfiguration()), hadoop


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that it means the same to Spark and to other readers."""
    files, hadoop = file_system(spark, path)
    return files.makeQualified(hadoop).toString()


def _write(files, path, text: str) -> None:
    out = files.create(path, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file whole, unless one of that name is there; says whether it was written.

    The text goes to a file beside it, which then takes the name in one step that fails if the
    name is taken: a link on a local disk, a rename without overwriting elsewhere. The store
    must be able to do one of these; object stores without a rename of their own are not.
    """
    files, target = file_system(spark, path)
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    _write(files, draft, text)
    try:
        if files.getUri().getScheme() == "file":
            try:
                os.link(draft.toUri().getPath(), target.toUri().getPath())
                return True
            except FileExistsError:
                return False
        if files.exists(target):
            return False
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
        )
        try:
            context.rename(draft, target, options)
            return True
        except Py4JJavaError:
            if files.exists(target):
                return False
            raise
    finally:
        files.delete(draft, False)


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions in a log's folder, in order."""
    files, path = file_system(spark, folder)
    if not files.exists(path):
        return []
    names = [status.getPath().getName() for status in files.listStatus(path)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def _entry_path(folder: str, version: int) -> str:
    return os.path.join(folder, f"{version:0{DIGITS}d}.json")


def read_log(spark: SparkSession, folder: str, schema: str, upto: int | None = None) -> DataFrame:
    """The entries as rows of `schema`, which may name `version`."""
    found = [v for v in versions(spark, folder) if upto is None or v <= upto]
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json([_entry_path(folder, version) for version in found])


def read_entry(spark: SparkSession, folder: str, version: int) -> dict:
    files, path = file_system(spark, _entry_path(folder, version))
    stream = files.open(path)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def append(spark: SparkSession, folder: str, make: Callable[[int, dict], dict]) -> dict:
    """Add an entry and return it. `make` gets its version and the entry before, {} if it is the
    first, and is asked again whenever another writer was first. It may raise `Conflict`."""
    files, path = file_system(spark, folder)
    files.mkdirs(path)
    for _ in range(MAX_TRIES):
        last = max(versions(spark, folder), default=0)
        before = read_entry(spark, folder, last) if last else {}
        entry = {**make(last + 1, before), "version": last + 1}
        if put_if_absent(spark, _entry_path(folder, last + 1), json.dumps(entry)):
            return entry
    raise Conflict(f"{MAX_TRIES} other writers were first in {folder}")
