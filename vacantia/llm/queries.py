"""The operators as queries over the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import (
    decontaminate,
    fertility,
    langid,
    linededup,
    packing,
    pii,
    prefixtable,
    resample,
    secrets,
    simhash,
    urls,
    warc,
    whitening,
)
from vacantia.llm.common import table

TOKENIZERS = "VACANTIA_TOKENIZERS"


def tokenizer_path(name: str) -> str:
    """A public vocabulary file: from the folder in the environment setting, or as installed."""
    folder = os.environ.get(TOKENIZERS)
    return os.path.join(folder, name) if folder else public_tokenizers.path(name)


def byte_vocabulary() -> str:
    return tokenizer_path("byte_bpe_50k.json")


def piece_vocabulary() -> str:
    return tokenizer_path("piece_bpe_32k.model")


def op1_warc_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op2_pii_bootstrap(spark: SparkSession, folder: str) -> DataFrame:
    return pii.personal_data(table(spark, folder, "documents"))


def op3_template_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return found.drop("text_key")


def op4_simhash_bk_tree(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    written = F.lpad(F.lower(F.hex("print")), 16, "0")
    return found.select("doc_id", written.alias("fingerprint"), "component_id")


def op5_tokeniser_fertility(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    judged = fertility.judge(documents, byte_vocabulary(), piece_vocabulary())
    return judged.drop("text_key")


def op6_secret_network(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan(table(spark, folder, "documents"))


def op7_minimum_bin_slack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), byte_vocabulary())


def op8_language_hierarchy(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = linededup.drop_repeated_lines(
        table(spark, folder, "documents").select("doc_id", "text")
    )
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op10_url_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """A page's outcome is the label of the document that the number in its url names."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    number = F.regexp_extract(urls.path(F.col("url")), r"^/[a-z]+/([0-9]+)", 1)
    labelled = (
        table(spark, folder, "labels")
        .groupBy("doc_id")
        .agg(F.max(((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")).alias("bad"))
    )
    outcomes = pages.select(
        urls.host(F.col("url")).alias("host"), number.try_cast("bigint").alias("doc_id")
    ).join(labelled, "doc_id")
    return urls.judge_urls(pages, outcomes).select("page_id", "host", "path", "rule", "verdict")


def op11_crc_resampling(spark: SparkSession, folder: str) -> DataFrame:
    drawn = resample.resample(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )
    return drawn.drop("n_words")


def op12_prefix_table(spark: SparkSession, folder: str) -> DataFrame:
    encoded = prefixtable.encode(table(spark, folder, "documents"), piece_vocabulary())
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op13_jacobi_davidson(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_warc_dictionary,
            op2_pii_bootstrap,
            op3_template_decontamination,
            op4_simhash_bk_tree,
            op5_tokeniser_fertility,
            op6_secret_network,
            op7_minimum_bin_slack,
            op8_language_hierarchy,
            op9_line_dedup,
            op10_url_reputation,
            op11_crc_resampling,
            op12_prefix_table,
            op13_jacobi_davidson,
        )
    }
