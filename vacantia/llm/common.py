"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# --- fixed values: what separates words ---
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# --- end of fixed values ---


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; null counts as empty."""
    return [value or "" for value in batch.column(column).to_pylist()]


def map_batches(
    rows: DataFrame, schema: str, make: Callable[[pa.RecordBatch], dict[str, Iterable]]
) -> DataFrame:
    """Apply `make` to each Arrow batch. It returns the columns of `schema`, all of one length."""
    types = rows.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow_schema(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch)
            columns = [made[field.name] for field in arrow]
            yield pa.RecordBatch.from_arrays(
                [
                    values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type)
                    for values, field in zip(columns, arrow)
                ],
                schema=arrow,
            )

    return rows.mapInArrow(run, types)


def free_name(rows: DataFrame, name: str) -> str:
    """A column name that the rows don't have yet."""
    taken = {column.lower() for column in rows.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_key(rows: DataFrame) -> Column:
    """With doc_id, what tells documents apart, also those without an id."""
    return F.xxhash64(rows["text"], F.length(rows["text"]))


def filter_documents(documents: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Documents whose (doc_id, text_key) is in `keys` ("left_semi") or isn't ("left_anti").
    Null ids compare equal."""
    keys = keys.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text")).distinct()
    same = documents["doc_id"].eqNullSafe(keys["_doc"]) & (text_key(documents) == keys["_text"])
    return documents.join(keys, same, how)
