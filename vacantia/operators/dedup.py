"""Repeated listings: report and removal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions.text import listing_code
from vacantia.operators.joins import is_small
from vacantia.scratch import stage, stage_counting


def with_code(lines: DataFrame) -> DataFrame:
    """Lines that start with a code, and the code."""
    return lines.withColumn("code", listing_code(F.col("raw"))).filter(F.col("code").isNotNull())


def positions(lines: DataFrame) -> DataFrame:
    """Where the lines that start with a code are, without their text."""
    code = listing_code(F.col("raw")).alias("code")
    return lines.select("source_file", "line_no", code).filter(F.col("code").isNotNull())


def listings_per_code(listings: DataFrame) -> DataFrame:
    return listings.groupBy("code").agg(F.count("*").alias("n"))


def duplicate_codes(listings: DataFrame) -> DataFrame:
    return listings_per_code(listings.filter(F.col("code").isNotNull())).filter(F.col("n") > 1)


def top_duplicates(listings: DataFrame, n: int | None = None) -> DataFrame:
    """Most repeated codes first; all of them when n is None or not positive."""
    ordered = duplicate_codes(listings).orderBy(F.desc("n"), "code")
    return ordered.limit(n) if n is not None and n > 0 else ordered


def first_per_code(
    listings: DataFrame, order: tuple[str, ...] = ("source_file", "line_no")
) -> DataFrame:
    """One listing per code, the first by (source_file, line_no) or by another order.

    The rank filter is pushed below the shuffle as a group limit, so a code that holds
    a large part of all rows sends one row per input partition.
    """
    ordered = Window.partitionBy("code").orderBy(*order)
    return (
        listings.withColumn("_rank", F.row_number().over(ordered))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def fetch(lines: DataFrame, pointers: DataFrame, keys: list[str]) -> DataFrame:
    """The lines that the pointers name, with the pointers' other columns.

    `keys` tell lines apart, so no key is hot. Few pointers are broadcast, and the lines stay
    where they are; otherwise they move once.
    """
    written = stage(pointers, "pointers")
    small = is_small(written, F.concat_ws("", *[F.col(name).cast("string") for name in written.columns]))
    return lines.join(F.broadcast(written) if small else written, keys)


def dedup_lines(lines: DataFrame) -> DataFrame:
    """One line per code, the first by (source_file, line_no). It is chosen by position; the
    text is fetched afterwards. `lines` is read twice, so give a written table."""
    return fetch(lines, first_per_code(positions(lines)), ["source_file", "line_no"])


def _copies() -> Column:
    """Records of a repeated code, the first one too."""
    return F.when(F.col("code").isNotNull() & (F.col("n") > 1), F.col("n")).otherwise(0)


def _share() -> Column:
    share = F.try_divide("duplicates", "records")
    return F.coalesce(share, F.lit(0.0)).alias("duplicate_share")


def duplicate_report(lines: DataFrame) -> DataFrame:
    """Records, copies of repeated codes (the first one too) and their share. Lines
    without a code count as records."""
    found = listings_per_code(lines).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.coalesce(F.sum(_copies()), F.lit(0)).alias("duplicates"),
    )
    return found.select("*", _share())


def duplicate_report_before_after(lines: DataFrame) -> DataFrame:
    """Both reports from one count per code: afterwards each code has one record."""
    found = listings_per_code(lines).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("records"),
        F.coalesce(F.sum(_copies()), F.lit(0)).alias("duplicates"),
        F.count("code").alias("codes"),
    )
    stages = F.array(
        F.struct(F.lit("before").alias("stage"), "records", "duplicates"),
        F.struct(
            F.lit("after").alias("stage"),
            F.col("codes").alias("records"),
            F.lit(0).cast("bigint").alias("duplicates"),
        ),
    )
    return found.select(F.inline(stages)).select("records", "duplicates", _share(), "stage")


def dedup_with_report(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`dedup_lines` and the report before and after it. The report is counted while the
    positions of the first lines are written; nothing is scanned for it."""
    code = listing_code(F.col("raw")).alias("code")
    counted = (
        lines.select("source_file", "line_no", code)
        .groupBy("code")
        .agg(F.min(F.struct("source_file", "line_no")).alias("first"), F.count("*").alias("n"))
    )
    written, counts = stage_counting(
        counted, "first-lines", records=F.sum("n"), duplicates=F.sum(_copies()), codes=F.count("code")
    )
    kept = fetch(
        lines, written.filter("code is not null").select("code", "first.*"), ["source_file", "line_no"]
    )
    rows = [
        (counts["records"] or 0, counts["duplicates"] or 0, "before"),
        (counts["codes"], 0, "after"),
    ]
    report = lines.sparkSession.createDataFrame(rows, "records bigint, duplicates bigint, stage string")
    return kept, report.select("records", "duplicates", _share(), "stage")
