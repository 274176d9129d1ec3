"""History of inferences and their keyword effects: Parquet files and a commit log.

A commit is two entries of the log: the first takes the next id, which no other writer then
gets, the second, after the effects are written, makes the inference visible with all of them.
One that fails in between leaves nothing visible. A deletion is an entry too; of two that
delete the same inference, one fails.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.schemas import MARGINAL_EFFECTS
from vacantia.sources import commit_log
from vacantia.sources.commit_log import Conflict

MAX_KEYWORD_LENGTH = 100
ENTRY = (
    "version long, action string, id long, last_id long, segment_keyword string, "
    "start_date string, end_date string, inference_date string, sample_size long, "
    "vocabulary_size long"
)


def _path(root: str, table: str) -> str:
    return os.path.join(root, table)


def init_store(spark: SparkSession, root: str) -> None:
    """Create the folders that do not exist yet."""
    for table in ("log", "marginal_effects"):
        files, path = commit_log.file_system(spark, _path(root, table))
        files.mkdirs(path)


def read_inferences(
    spark: SparkSession, root: str, segment: str | None = None, version: int | None = None
) -> DataFrame:
    """The inferences that are there, or were at a version of the log, of a segment if given."""
    entries = commit_log.read_log(spark, _path(root, "log"), ENTRY, version)
    inferences = entries.filter("action = 'commit'")
    if segment is not None:
        inferences = inferences.filter(F.col("segment_keyword") == segment)
    deleted = entries.filter("action = 'delete'").select("id")
    times = [F.col(n).cast("timestamp").alias(n) for n in ("start_date", "end_date", "inference_date")]
    return inferences.join(deleted, "id", "left_anti").select(
        "id", "segment_keyword", *times, "sample_size", "vocabulary_size"
    )


def read_effects(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """Effects of the inferences that are there; deleted and half-written ones drop out."""
    effects = spark.read.schema(MARGINAL_EFFECTS).parquet(_path(root, "marginal_effects"))
    ids = read_inferences(spark, root, version=version).select(F.col("id").alias("inference_id"))
    return effects.join(ids, "inference_id", "left_semi")


def effects_by_inference(
    inferences: DataFrame,
    effects: DataFrame,
    segment: str | None = None,
    keyword: str | None = None,
) -> DataFrame:
    """Effects with the inference they belong to, by segment and keyword if given."""
    if segment is not None:
        inferences = inferences.filter(F.col("segment_keyword") == segment)
    if keyword is not None:
        effects = effects.filter(F.col("keyword") == keyword)
    owners = inferences.withColumnRenamed("id", "inference_id")
    return effects.join(owners, "inference_id")


def _check_effects(effects: DataFrame) -> None:
    names = ("keyword", "marginal_effect", "prop_doc")
    missing = [F.count_if(F.col(n).isNull()).alias(n) for n in names]
    too_long = F.count_if(F.length("keyword") > MAX_KEYWORD_LENGTH).alias("too_long")
    found = effects.agg(*missing, too_long).first().asDict()
    problems = {name: n for name, n in found.items() if n}
    if problems:
        raise ValueError(f"effects not stored, offending rows per check: {problems}")


def _as_text(when: dt.datetime) -> str:
    """ISO text with an offset; times without one are local."""
    return when.astimezone(dt.timezone.utc).isoformat(sep=" ")


def _reserve(spark: SparkSession, root: str) -> int:
    """An id that no other writer has or gets."""

    def entry(version: int, before: dict) -> dict:
        new_id = before.get("last_id", 0) + 1
        return {"action": "reserve", "id": new_id, "last_id": new_id}

    return commit_log.append(spark, _path(root, "log"), entry)["id"]


def commit_inference(
    spark: SparkSession,
    root: str,
    segment_keyword: str,
    start_date: dt.datetime,
    end_date: dt.datetime,
    sample_size: int,
    vocabulary_size: int,
    effects: DataFrame,
    inference_date: dt.datetime | None = None,
) -> int:
    """Store one inference with its effects; returns its id."""
    when = inference_date or dt.datetime.now(dt.timezone.utc)
    given = (segment_keyword, start_date, end_date, sample_size, vocabulary_size)
    if any(value is None for value in given):
        raise ValueError("an inference needs every field")
    if len(segment_keyword) > MAX_KEYWORD_LENGTH:
        raise ValueError("segment keyword is too long")
    init_store(spark, root)
    _check_effects(effects)
    new_id = _reserve(spark, root)
    effects.select(
        F.xxhash64(F.lit(new_id), "keyword").alias("id"), "keyword", "marginal_effect", "prop_doc"
    ).write.mode("overwrite").parquet(
        os.path.join(_path(root, "marginal_effects"), f"inference_id={new_id}")
    )

    def entry(version: int, before: dict) -> dict:
        return {
            "action": "commit",
            "id": new_id,
            "last_id": before["last_id"],
            "segment_keyword": segment_keyword,
            "start_date": _as_text(start_date),
            "end_date": _as_text(end_date),
            "inference_date": _as_text(when),
            "sample_size": sample_size,
            "vocabulary_size": vocabulary_size,
        }

    commit_log.append(spark, _path(root, "log"), entry)
    return new_id


def delete_inference(spark: SparkSession, root: str, inference_id: int) -> None:
    """Remove an inference; its effects go with it. One that is not there is a conflict."""

    def entry(version: int, before: dict) -> dict:
        alive = read_inferences(spark, root, version=version - 1)
        if alive.filter(F.col("id") == inference_id).isEmpty():
            raise Conflict(f"there is no inference {inference_id}")
        return {"action": "delete", "id": inference_id, "last_id": before["last_id"]}

    commit_log.append(spark, _path(root, "log"), entry)
