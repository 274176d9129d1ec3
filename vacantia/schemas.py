"""Schemas of the stored tables and documents."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_LISTINGS = "source_file string, line_no bigint, raw string"

PHRASE_DOCUMENT = """
    unigrams array<string>,
    bigrams array<string>,
    parameters struct<min_unigram_count: bigint, lift_threshold: double,
                      regex_pattern: string, total_documents: bigint>,
    artifact_sizes struct<significant_unigram_size: bigint, significant_bigram_size: bigint>,
    timestamp string
"""

RUN_METADATA = "feature_names array<string>, full_sample_size bigint, segment_keyword string"

INFERENCES = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("segment_keyword", T.StringType(), False),
        T.StructField("start_date", T.TimestampType(), False),
        T.StructField("end_date", T.TimestampType(), False),
        T.StructField("inference_date", T.TimestampType(), False),
        T.StructField("sample_size", T.LongType(), False),
        T.StructField("vocabulary_size", T.LongType(), False),
    ]
)

MARGINAL_EFFECTS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("keyword", T.StringType(), False),
        T.StructField("marginal_effect", T.DoubleType(), False),
        T.StructField("prop_doc", T.DoubleType(), False),
        T.StructField("inference_id", T.LongType(), False),
    ]
)
