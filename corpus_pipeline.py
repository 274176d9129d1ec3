"""From documents to packed sequences: five stages, each on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.llm import decontaminate, fertility, linededup, packing, simhash
from vacantia.llm.common import filter_documents, free_name, table
from vacantia.llm.queries import byte_vocabulary, piece_vocabulary
from vacantia.scratch import stage
from vacantia.shipping import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    ship(spark)
    judged = fertility.judge(docs, byte_vocabulary(), piece_vocabulary())
    return filter_documents(docs, judged.where("kept"), "left_semi")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds. n_chars follows the
    text; a document that loses every line stays, with an empty text."""
    ship(spark)
    kept = linededup.drop_repeated_lines(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return kept
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group. Rows that repeat a doc_id are one
    document, with the smallest text of theirs; those without one can't be told apart and stay."""
    ship(spark)
    groups = simhash.near_duplicates(docs.where(F.col("doc_id").isNotNull()))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    place = free_name(docs, "place")
    order = Window.partitionBy("doc_id").orderBy(F.asc_nulls_first("text"))
    ranked = docs.join(first, "doc_id", "left_semi").withColumn(place, F.row_number().over(order))
    kept = ranked.where(F.col(place) == 1).drop(place)
    return kept.unionAll(docs.where(F.col("doc_id").isNull()))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    ship(spark)
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return filter_documents(docs, found, "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    ship(spark)
    return packing.pack(docs, byte_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pack", pack),
]

# Tokens, fingerprints and packing are beyond SQL; tests run a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
