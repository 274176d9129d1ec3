"""Listings per day and weekly snapshot bookkeeping."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.dates import next_friday, publication_date

DEFAULT_SPAN_DAYS = 60


def with_publication_date(lines: DataFrame) -> DataFrame:
    return lines.withColumn("pub_date", publication_date(F.col("raw")))


def listings_per_date(listings: DataFrame) -> DataFrame:
    """(date, count) in date order; listings without a date are left out."""
    return (
        listings.filter(F.col("pub_date").isNotNull())
        .groupBy(F.col("pub_date").alias("date"))
        .agg(F.count("*").alias("count"))
        .orderBy("date")
    )


def _days(spark: SparkSession, start: dt.date, end: dt.date, step_days: int) -> DataFrame:
    step = F.expr(f"interval {step_days} days")
    days = F.explode(F.sequence(F.lit(start), F.lit(end), step))
    return spark.range(1).select(days.alias("date")) if start <= end else spark.createDataFrame(
        [], "date date"
    )


def calendar_counts(
    counts: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    mark_weekday: int = 0,
) -> DataFrame:
    """Every day of the range with its count, 0 where there is none."""
    today = dt.date.today()
    end = end or today
    start = start or today - dt.timedelta(days=DEFAULT_SPAN_DAYS)
    days = _days(counts.sparkSession, start, end, 1)
    return days.join(counts, "date", "left").select(
        "date",
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"),
        (F.weekday("date") == mark_weekday).alias("marked"),
    )


def missing_weeks(processed: DataFrame, start: dt.date, today: dt.date) -> DataFrame:
    """Fridays from a start date up to today that have no processed snapshot yet."""
    first = start + dt.timedelta(days=(4 - start.weekday()) % 7)
    fridays = _days(processed.sparkSession, first, today, 7).withColumnRenamed("date", "snapshot_date")
    return fridays.join(processed, "snapshot_date", "left_anti")


def last_processed(processed: DataFrame, start: dt.date) -> DataFrame:
    """The latest processed snapshot (the start date if none) and the Friday after it."""
    latest = F.coalesce(F.max("snapshot_date"), F.lit(start))
    return processed.agg(latest.alias("last_processed")).withColumn(
        "next_friday", next_friday(F.col("last_processed"))
    )


def run_last_date(cards: DataFrame) -> DataFrame:
    """Publication date of the last card of each run (by position)."""
    return cards.groupBy("source_file").agg(F.max_by("pub_date", "line_no").alias("last_date"))


def temporal_scope(listings: DataFrame, target: dt.date, days: int) -> DataFrame:
    """Listings published within a number of days up to the target date."""
    age = F.datediff(F.lit(target), F.col("pub_date"))
    return listings.filter(age.between(0, days))


def newest_listings(listings: DataFrame, n: int) -> DataFrame:
    """At most n listings, the newest first."""
    return listings.orderBy(F.desc("pub_date"), "code").limit(n)
