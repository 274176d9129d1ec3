"""Keyword effects on wages: proportions, contrasts, discovery tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.operators.ranking import add_average_rank
from vacantia.scratch import stage


def _term_rows(samples: DataFrame, *columns: str) -> DataFrame:
    """One row per sample and distinct feature."""
    return samples.select(F.explode(F.array_distinct("ngrams")).alias("keyword"), *columns)


def term_prop_doc(samples: DataFrame) -> DataFrame:
    """Share of samples that have the feature."""
    total = samples.agg(F.count("*")).scalar()
    return (
        _term_rows(samples)
        .groupBy("keyword")
        .agg(F.count("*").alias("n_docs"))
        .withColumn("prop_doc", F.col("n_docs") / total)
    )


def term_wage_contrast(samples: DataFrame) -> DataFrame:
    """Mean log wage with the feature minus the mean without it; NULL if all have it."""
    totals = samples.agg(
        F.struct(F.count("*").alias("n"), F.sum("log_wage").alias("s"))
    ).scalar()
    with_term = (
        _term_rows(samples, "log_wage")
        .groupBy("keyword")
        .agg(F.count("*").alias("n_docs"), F.sum("log_wage").alias("s"))
    )
    mean_with = F.col("s") / F.col("n_docs")
    mean_without = F.try_divide(totals["s"] - F.col("s"), totals["n"] - F.col("n_docs"))
    return with_term.select(
        "keyword",
        (mean_with - mean_without).alias("marginal_effect"),
        (F.col("n_docs") / totals["n"]).alias("prop_doc"),
    )


def in_discovery_range(
    effects: DataFrame, bounds: tuple[float, float] = C.DISCOVERY_RANGE
) -> DataFrame:
    return effects.filter(F.col("prop_doc").between(*bounds))


def effects_discovery(
    effects: DataFrame, bounds: tuple[float, float] = C.DISCOVERY_RANGE
) -> DataFrame:
    """Effects in the discovery range, with the proportion in percent."""
    return in_discovery_range(effects, bounds).withColumn("prop_doc", F.col("prop_doc") * 100)


def effects_rank(
    effects: DataFrame, bounds: tuple[float, float] = C.DISCOVERY_RANGE, top_n: int = 10
) -> DataFrame:
    """Rank by effect, ties averaged, and the mark size and colour of the top ones. Effects
    that are NULL have no rank. No task ranks them all, whatever the bounds."""
    rows = stage(effects_discovery(effects, bounds), "effects")
    top = F.col("rank") <= top_n
    return (
        add_average_rank(rows, "marginal_effect", "rank")
        .withColumn(
            "size",
            F.lit(float(C.BASE_MARK_SIZE)) + F.when(top, top_n - F.col("rank")).otherwise(0.0),
        )
        .withColumn("color", F.when(top, F.col("rank")).otherwise(F.lit(0.0)))
    )


def effects_top_abs(
    effects: DataFrame, bounds: tuple[float, float] = C.DISCOVERY_RANGE, top_n: int = 10
) -> DataFrame:
    """The largest absolute effects in the discovery range, smallest of them first."""
    size = F.abs("marginal_effect")
    top = in_discovery_range(effects, bounds).orderBy(F.desc(size), "keyword").limit(top_n)
    return top.orderBy(size, F.desc("keyword"))
