"""Phrase features and wage labels of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.wage import log_wage, wage_label
from vacantia.operators.joins import BROADCAST_BYTES, is_small
from vacantia.operators.matching import match_by_broadcast, match_by_joins, match_by_pair_files
from vacantia.operators.term_index import MOST_PAIRS, MOST_WORDS


def phrase_features(
    listings: DataFrame,
    unigrams: DataFrame,
    bigrams: DataFrame,
    token_pattern: str | None = C.TOKEN_PATTERN,
    drop_low_order_ngrams: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
    most_pairs: int = MOST_PAIRS,
) -> DataFrame:
    """Add `unigrams`, `bigrams` and the feature list `ngrams` of each listing.

    Words outside the unigram vocabulary leave the list first; pairs are neighbours in
    what remains. Features are the unigrams, then the known pairs, order and repeats
    kept. The vocabularies are measured and then read: stage them.
    """
    if token_pattern is not None:
        # A word passes the pattern and is known just when it is a known word that passes.
        unigrams = unigrams.filter(F.col("term").rlike(token_pattern))
    small_words = is_small(unigrams, "term", broadcast_bytes, MOST_WORDS)
    if small_words and is_small(bigrams, "term", broadcast_bytes):
        matched = match_by_broadcast(listings, unigrams, bigrams, drop_low_order_ngrams)
    elif small_words and (pairs := bigrams.count()) <= most_pairs:
        matched = match_by_pair_files(listings, unigrams, bigrams, drop_low_order_ngrams, pairs)
    else:
        matched = match_by_joins(listings, unigrams, bigrams, drop_low_order_ngrams, small_words)
    return matched.withColumn("ngrams", F.concat("kept", "bigrams")).drop("kept")


def wages_and_features(
    listings: DataFrame, unigrams: DataFrame, bigrams: DataFrame, **options
) -> DataFrame:
    """Labelled pairs: `wage` (NULL without a range) and `ngrams` per listing."""
    featured = phrase_features(listings, unigrams, bigrams, **options)
    return featured.withColumn("wage", wage_label(F.col("wage_info")))


def is_valid_sample() -> Column:
    has_null = F.exists("ngrams", lambda term: term.isNull())
    return F.col("ngrams").isNotNull() & ~has_null


def sample_validity(samples: DataFrame) -> DataFrame:
    """Number of samples, of valid ones, and the valid share (0 if there are none)."""
    valid = F.coalesce(is_valid_sample(), F.lit(False))
    return samples.agg(
        F.count("*").alias("total"), F.count_if(valid).alias("valid")
    ).withColumn("valid_share", F.coalesce(F.try_divide("valid", "total"), F.lit(0.0)))


def valid_samples(samples: DataFrame, min_share: float = C.MIN_VALID_SHARE) -> DataFrame:
    """The valid samples; an error if their share is below the minimum."""
    report = sample_validity(samples).first()
    check_validity(report.total, report.valid, min_share)
    return samples.filter(is_valid_sample())


def check_validity(total: int, valid: int, min_share: float = C.MIN_VALID_SHARE) -> None:
    """An error if too few of the samples are valid."""
    if (valid / total if total else 0.0) < min_share:
        raise ValueError(
            f"{valid} of {total} samples are valid, a share of {min_share:.0%} is required"
        )


def label_counts(samples: DataFrame) -> DataFrame:
    """How many samples have a usable wage, none at all, or one that is not positive."""
    return samples.agg(
        F.count_if(F.col("wage") > 0).alias("labelled"),
        F.count_if(F.col("wage").isNull()).alias("unlabelled"),
        F.count_if(F.col("wage") <= 0).alias("not_positive"),
    )


def labelled_listings(listings: DataFrame) -> DataFrame:
    """The listings that become labelled samples, found before their words are matched: a match
    by blocks lets no filter on the wage pass."""
    return listings.filter(wage_label(F.col("wage_info")) > 0)


def labelled_samples(samples: DataFrame) -> DataFrame:
    """Samples with a positive wage, and its logarithm."""
    return samples.filter(F.col("wage") > 0).withColumn("log_wage", log_wage(F.col("wage")))
