"""From raw lines to curated, standardised listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.text import TextStep, standardize
from vacantia.functions.wage import split_wage_info, wage_bound
from vacantia.operators.calendar import with_publication_date
from vacantia.operators.dedup import first_per_code, with_code


def standardised(
    lines: DataFrame,
    steps: Sequence[TextStep] | None = None,
    wage_pattern: str = C.WAGE_TRIPLET_PATTERN,
) -> DataFrame:
    """Add `wage_info`, its bounds and the remaining standardised `text`."""
    plain = lines.withColumn("_standard", standardize(F.col("raw"), steps))
    info, rest = split_wage_info(F.col("_standard"), wage_pattern)
    # As a generated row, so that a later filter on these columns is not rewritten to one
    # that evaluates the expressions behind them once more.
    split = F.inline(F.array(F.struct(info.alias("wage_info"), rest.alias("text"))))
    return (
        plain.select("*", split)
        .withColumns(
            {
                "wage_low": wage_bound(F.col("wage_info"), 1),
                "wage_high": wage_bound(F.col("wage_info"), 2),
            }
        )
        .drop("_standard")
    )


def listings(
    lines: DataFrame,
    steps: Sequence[TextStep] | None = None,
    wage_pattern: str = C.WAGE_TRIPLET_PATTERN,
) -> DataFrame:
    """One standardised listing per code, with its publication date."""
    return standardised(with_publication_date(first_per_code(with_code(lines))), steps, wage_pattern)
