"""The batch jobs: phrase discovery, training samples, wage driver discovery."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.text import contains_keyword
from vacantia.operators.features import (
    check_validity,
    is_valid_sample,
    labelled_samples,
    wages_and_features,
)
from vacantia.operators.joins import BROADCAST_BYTES, is_small
from vacantia.operators.network import mean_gradients, train_wage_network
from vacantia.operators.phrases import (
    RARE_LIFT,
    bigram_counts,
    bigram_lift,
    filtered_pair_lift,
    frequent_pair_lift,
    significant_bigrams,
    significant_unigrams,
    unigram_counts,
)
from vacantia.operators.regression import fit_wage_regression, marginal_effects
from vacantia.operators.splits import train_test_split
from vacantia.operators.term_index import MOST_WORDS
from vacantia.operators.vectors import vectorize
from vacantia.scratch import scope, stage, stage_counting
from vacantia.sources.folds import persist_folds, read_folds, read_run_metadata
from vacantia.sources.inference_store import commit_inference
from vacantia.sources.phrase_documents import export_ordered


@dataclass
class Phrases:
    """Significant phrases of a set of listings, with the counts behind them."""

    documents: int
    unigrams: DataFrame
    bigrams: DataFrame
    parameters: dict


def document_count(texts: DataFrame):
    return texts.agg(F.count("*")).scalar()


def lifts_of(
    texts: DataFrame,
    min_count: int = C.MIN_UNIGRAM_COUNT,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Lift of every pair, rare ones included."""
    counts = stage(unigram_counts(texts), "unigram-counts")
    small = is_small(counts.filter(F.col("n") >= min_count), "term", broadcast_bytes)
    return bigram_lift(counts, bigram_counts(texts), document_count(texts), min_count, small)


def discover_phrases(
    texts: DataFrame,
    min_count: int = C.MIN_UNIGRAM_COUNT,
    lift_threshold: float = C.LIFT_THRESHOLD,
    pattern: str = C.PHRASE_PATTERN,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> Phrases:
    """Phrases of standardised listings. `texts` is scanned several times: stage it.

    The word counts serve the lift and the word list, so they are written once; so are
    the phrases, which every later step matches against.
    """
    counts = stage(unigram_counts(texts), "unigram-counts")
    frequent = counts.filter(F.col("n") >= min_count)
    if lift_threshold >= RARE_LIFT:
        # No pair with a rare word can pass, so leaving those out first changes nothing.
        if is_small(frequent, "term", broadcast_bytes, MOST_WORDS):
            lifts = frequent_pair_lift(texts, frequent, document_count(texts))
        else:
            lifts = filtered_pair_lift(texts, frequent, document_count(texts), frequent.count())
    else:
        small = is_small(frequent, "term", broadcast_bytes)
        lifts = bigram_lift(counts, bigram_counts(texts), document_count(texts), min_count, small)
    return Phrases(
        documents=texts.count(),
        unigrams=significant_unigrams(counts, min_count, pattern),
        bigrams=stage(significant_bigrams(lifts, lift_threshold, pattern), "bigrams"),
        parameters={
            "min_unigram_count": min_count,
            "lift_threshold": lift_threshold,
            "regex_pattern": pattern,
        },
    )


def export_significant_phrases(texts: DataFrame, path: str, **options) -> Phrases:
    phrases = discover_phrases(texts, **options)
    parameters = {**phrases.parameters, "total_documents": phrases.documents}
    export_ordered(phrases.unigrams, phrases.bigrams, parameters, path)
    return phrases


def build_training_samples(
    texts: DataFrame,
    unigrams: DataFrame,
    bigrams: DataFrame,
    segment: str,
    folder: str,
    min_df: int = C.MIN_DOCUMENT_FREQUENCY,
) -> None:
    """Segment -> labelled phrase features -> vectors -> folds and metadata."""
    with scope(texts.sparkSession):
        segment_texts = texts.filter(contains_keyword(F.col("text"), segment))
        samples, counts = stage_counting(
            wages_and_features(segment_texts, unigrams, bigrams).select("code", "wage", "ngrams"),
            "samples",
            total=F.count("*"),
            valid=F.count_if(F.coalesce(is_valid_sample(), F.lit(False))),
        )
        check_validity(counts["total"], counts["valid"])
        labelled = labelled_samples(samples.filter(is_valid_sample()))
        vectors, names = vectorize(labelled, min_df)
        metadata = {
            "feature_names": names,
            "full_sample_size": counts["total"],
            "segment_keyword": segment,
        }
        persist_folds(vectors.select("code", "wage", "log_wage", "features"), folder, metadata)


def split_folds(
    spark: SparkSession, folder: str, test_share: float, seed: int, use_log_wage: bool = True
) -> DataFrame:
    samples = read_folds(spark, folder, use_log_wage).select("code", "features", "label")
    return train_test_split(samples, "code", test_share, seed)


def discover_wage_drivers(
    spark: SparkSession,
    folder: str,
    store: str,
    start_date: dt.datetime,
    end_date: dt.datetime,
    model: str = "linear",
    test_share: float = 0.5,
    epochs: int = 150,
    threshold: float = 0.005,
    window: int = 15,
    seed: int = C.FOLD_SEED,
    use_log_wage: bool = True,
    **fitting: float,
) -> int:
    """Fit on the stored folds, take the effects on the validation rows, store them.

    `fitting` goes to the linear regression: its penalty and when it stops.
    """
    metadata = read_run_metadata(spark, folder)
    names = metadata.feature_names
    samples = split_folds(spark, folder, test_share, seed, use_log_wage)
    validation = samples.filter(~F.col("is_train"))
    if model == "linear":
        train = samples.filter("is_train")
        gradients = fit_wage_regression(train, **fitting).coefficients.toArray()
    elif model == "network":
        trained = train_wage_network(
            samples, len(names), epochs=epochs, threshold=threshold, window=window
        )
        gradients = mean_gradients(validation, trained.weights)
    else:
        raise ValueError(f"unknown model: {model}")
    effects = marginal_effects(validation, names, gradients)
    return commit_inference(
        spark,
        store,
        segment_keyword=metadata.segment_keyword,
        start_date=start_date,
        end_date=end_date,
        sample_size=metadata.full_sample_size,
        vocabulary_size=len(names),
        effects=effects,
    )
