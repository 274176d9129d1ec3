"""Export and import of significant phrases as JSON documents.

`export_ordered` writes one document of any size from many tasks: a folder of parts that, one
after the other in the order of their names, are the document, with its terms in order.
`export_phrases` writes documents of one file each, for other readers of the format.
"""

from __future__ import annotations

import datetime as dt

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.scratch import scope, stage_counting
from vacantia.schemas import PHRASE_DOCUMENT

# Sections of an ordered document, named so that they sort in its order.
HEAD, UNIGRAMS, BETWEEN, BIGRAMS, TAIL = "0-head", "1-unigrams", "2-between", "3-bigrams", "4-tail"


def _ordered_terms(terms: DataFrame, section: str) -> tuple[DataFrame, int]:
    """Lines of one section with a term each, a comma before all but the first; their number.
    Repeated terms are written once."""
    distinct = terms.select("term").where("term is not null").distinct()
    written, counts = stage_counting(distinct, "terms", n=F.count("*"), first=F.min("term"))
    # A string as JSON: what stands between the brackets of a list of it.
    quoted = F.regexp_replace(F.to_json(F.array("term")), r"^\[|\]$", "")
    comma = F.when(F.col("term") == F.lit(counts["first"]), F.lit("")).otherwise(F.lit(","))
    lines = written.select(F.lit(section).alias("section"), "term", F.concat(comma, quoted).alias("line"))
    return lines, counts["n"]


def export_ordered(
    unigrams: DataFrame,
    bigrams: DataFrame,
    parameters: dict,
    path: str,
    timestamp: dt.datetime | None = None,
) -> None:
    """Write the phrases with their parameters and sizes as one document in many parts.

    The terms are dealt out by ranges, so each task sorts and writes a stretch of the document;
    no task and no row holds them all.
    """
    spark = unigrams.sparkSession
    with scope(spark):
        words, n_words = _ordered_terms(unigrams, UNIGRAMS)
        pairs, n_pairs = _ordered_terms(bigrams, BIGRAMS)
        sizes = {"significant_unigram_size": n_words, "significant_bigram_size": n_pairs}
        stamp = (timestamp or dt.datetime.now()).isoformat()
        about = {"parameters": parameters, "artifact_sizes": sizes, "timestamp": stamp}
        frame = [
            (HEAD, None, json.dumps(about)[:-1] + ', "unigrams": ['),
            (BETWEEN, None, '], "bigrams": ['),
            (TAIL, None, "]}"),
        ]
        (
            words.unionByName(pairs)
            .unionByName(spark.createDataFrame(frame, "section string, term string, line string"))
            .repartitionByRange("section", "term")
            .sortWithinPartitions("section", "term")
            .select("section", "line")
            .write.partitionBy("section")
            .text(path)
        )


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("line string, section string").text(path)


def read_about(spark: SparkSession, path: str) -> dict:
    """Parameters, sizes and time of an ordered document."""
    head = _lines(spark, path).filter(F.col("section") == HEAD).first()
    return json.loads(head.line.removesuffix(', "unigrams": [') + "}")


def import_ordered(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(unigrams, bigrams) of an ordered document, each a `term` column. A missing path or a line
    that is no JSON string is an error."""

    def terms(section: str) -> DataFrame:
        lines = _lines(spark, path).filter(F.col("section") == section)
        listed = F.concat(F.lit("["), F.regexp_replace("line", "^,", ""), F.lit("]"))
        parsed = F.from_json(listed, "array<string>", {"mode": "FAILFAST"})
        return lines.select(F.element_at(parsed, 1).alias("term"))

    return terms(UNIGRAMS), terms(BIGRAMS)


def export_phrases(
    unigrams: DataFrame,
    bigrams: DataFrame,
    parameters: dict,
    path: str,
    timestamp: dt.datetime | None = None,
    documents: int = 1,
) -> None:
    """Write the phrases with their parameters and sizes.

    One document, as readers of the format expect. For a vocabulary too large for one task
    ask for several `documents`: each has the same parameters and a part of the terms.
    """
    n_unigrams, n_bigrams = unigrams.count(), bigrams.count()
    terms = unigrams.select("term", F.lit(1).alias("size")).unionByName(
        bigrams.select("term", F.lit(2).alias("size"))
    )
    # A document with no term still carries the parameters.
    numbers = terms.sparkSession.range(documents).select(F.col("id").alias("document"))
    placed = terms.withColumn(
        "document", F.pmod(F.xxhash64("term"), F.lit(documents)).cast("bigint")
    )
    stamp = (timestamp or dt.datetime.now()).isoformat()
    (
        numbers.join(placed, "document", "left")
        .groupBy("document")
        .agg(
            F.sort_array(F.collect_list(F.when(F.col("size") == 1, F.col("term")))).alias("unigrams"),
            F.sort_array(F.collect_list(F.when(F.col("size") == 2, F.col("term")))).alias("bigrams"),
        )
        .select(
            "document",
            "unigrams",
            "bigrams",
            F.struct(*[F.lit(v).alias(k) for k, v in parameters.items()]).alias("parameters"),
            F.struct(
                F.lit(n_unigrams).alias("significant_unigram_size"),
                F.lit(n_bigrams).alias("significant_bigram_size"),
            ).alias("artifact_sizes"),
            F.lit(stamp).alias("timestamp"),
        )
        .write.partitionBy("document")
        .json(path)
    )


def read_phrase_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents as rows. A missing path or malformed JSON is an error."""
    return (
        spark.read.schema(PHRASE_DOCUMENT)
        .option("multiLine", True)
        .option("mode", "FAILFAST")
        .json(path)
    )


def import_phrases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(unigrams, bigrams), each a `term` column; a missing key means no terms."""
    documents = read_phrase_documents(spark, path)
    unigrams, bigrams = (
        documents.select(F.explode(name).alias("term")).distinct() for name in ("unigrams", "bigrams")
    )
    return unigrams, bigrams
