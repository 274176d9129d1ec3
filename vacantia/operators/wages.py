"""Wage distributions of raw listings, overall and in a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.text import contains_keyword
from vacantia.functions.wage import wage_category, wage_label, wage_midpoint
from vacantia.operators.splits import bernoulli_sample


def wage_facts(
    lines: DataFrame, segment: str | None = "python", pattern: str = C.WAGE_CATEGORY_PATTERN
) -> DataFrame:
    """Replace the raw line by its wage category and whether it is in the segment.

    Do this before lines are deduplicated, and the text stays out of the shuffle.
    """
    in_segment = contains_keyword(F.col("raw"), segment) if segment else F.lit(False)
    return lines.withColumns(
        {"wage_category": wage_category(F.col("raw"), pattern), "in_segment": in_segment}
    ).drop("raw")


def sampled(facts: DataFrame, rate: float, key: str = "code", seed: int = C.FOLD_SEED) -> DataFrame:
    """The facts that a wage analysis at this sampling rate looks at; all of them at 1."""
    if not 0 < rate <= 1:
        raise ValueError(f"rate must be above 0 and at most 1: {rate}")
    return facts if rate == 1 else bernoulli_sample(facts, rate, key, seed)


def wage_distribution(facts: DataFrame) -> DataFrame:
    """Share of each wage category and its midpoint, overall and in the segment.

    Every segment listing is also an overall one, so one aggregate gives both sides of
    the outer join: segment columns are NULL for categories the segment lacks, and
    without a segment. Ordered by midpoint, unspecified wages last.
    """
    counts = facts.groupBy("wage_category").agg(
        F.count("*").alias("n_overall"), F.count_if("in_segment").alias("n_segment")
    )
    totals = counts.agg(
        F.struct(F.sum("n_overall").alias("overall"), F.sum("n_segment").alias("segment"))
    ).scalar()
    in_segment = F.col("n_segment") > 0
    midwage = wage_midpoint(F.col("wage_category"))
    return counts.select(
        "wage_category",
        (F.col("n_overall") / totals["overall"]).alias("proportion_overall"),
        midwage.alias("midwage_overall"),
        F.when(in_segment, F.col("n_segment") / totals["segment"]).alias("proportion_segment"),
        F.when(in_segment, midwage).alias("midwage_segment"),
    ).orderBy(F.asc_nulls_last("midwage_overall"), "wage_category")


def wage_missing_share(facts: DataFrame) -> DataFrame:
    """Share of listings with and without a wage, per scope (overall, segment).

    A scope without listings has share 0 for both.
    """
    flags = facts.select((F.col("wage_category") == C.NOT_SPECIFIED).alias("missing"), "in_segment")
    counts = flags.agg(
        F.count("*").alias("overall"),
        F.count_if("missing").alias("overall_missing"),
        F.count_if("in_segment").alias("segment"),
        F.count_if(F.col("in_segment") & F.col("missing")).alias("segment_missing"),
    )

    def share(part, whole):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    rows = [
        F.struct(
            F.lit(scope).alias("scope"),
            F.lit(name).alias("wage_status"),
            share(part, F.col(scope)).alias("share"),
        )
        for scope in ("overall", "segment")
        for name, part in (
            (C.WAGE_PROVIDED, F.col(scope) - F.col(f"{scope}_missing")),
            (C.NOT_SPECIFIED, F.col(f"{scope}_missing")),
        )
    ]
    return counts.select(F.inline(F.array(*rows)))


def segment_pay(listings: DataFrame, keyword: str) -> DataFrame:
    """Labelled listings of a text segment and their mean wage."""
    return (
        listings.filter(contains_keyword(F.col("text"), keyword))
        .select(wage_label(F.col("wage_info")).alias("wage"))
        .agg(F.count("wage").alias("listings"), F.avg("wage").alias("mean_wage"))
    )
