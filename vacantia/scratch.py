"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_local_folders: dict[str, str] = {}
_deleted_at_exit: set[str] = set()
_open_scopes = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a local session without one gets its own."""
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="vacantia-")
    return _local_folders[application]


def _own_folder(spark: SparkSession) -> str:
    """The application's folder in the shared one, which goes when the application ends."""
    context = spark.sparkContext
    folder = os.path.join(shared_folder(spark), f"vacantia-{context.applicationId}")
    if folder not in _deleted_at_exit:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _deleted_at_exit.add(folder)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(_own_folder(spark), f"{name}-{uuid.uuid4().hex}")


def stage(table: DataFrame, name: str) -> DataFrame:
    """Write a table that several later scans need and read it back.

    Cuts the lineage: an executor lost afterwards costs a re-read, not a recomputation,
    and each later scan reads only the columns it uses.
    """
    path = fresh_folder(table.sparkSession, name)
    for paths in getattr(_open_scopes, "stack", [])[-1:]:
        paths.append(path)
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def stage_counting(table: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates over the table that are taken while it is written."""
    observation = Observation()
    observed = table.observe(observation, *[value.alias(key) for key, value in counts.items()])
    staged = stage(observed, name)
    return staged, observation.get


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that this thread stages inside are deleted at the end, for jobs whose results are
    written by then. Others stay until the application ends."""
    stack = _open_scopes.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        context = spark.sparkContext
        for folder in stack.pop():
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
