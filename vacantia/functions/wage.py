"""Wage expressions: categories of raw lines, wage_info and labels of listings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.text import strip


def _midpoint(low: Column, high: Column) -> Column:
    """Half of the sum of two digit strings, exact while both fit a BIGINT."""
    total = F.try_add(low.try_cast("bigint"), high.try_cast("bigint")).cast("double")
    wide = low.try_cast("double") + high.try_cast("double")
    return F.coalesce(total, wide) / F.lit(2.0)


def wage_category(raw: Column, pattern: str = C.WAGE_CATEGORY_PATTERN) -> Column:
    found = F.regexp_extract(raw, pattern, 0)
    return F.when(found.isin("", C.TO_BE_AGREED_RAW), F.lit(C.NOT_SPECIFIED)).otherwise(found)


def wage_midpoint(category: Column) -> Column:
    """Midpoint of `$a - $b`; NULL for any other category, also for `$a-$b`."""

    def amount(group: int) -> Column:
        return F.translate(F.regexp_extract(category, C.WAGE_MIDPOINT_PATTERN, group), ".,", "")

    return F.when(category.rlike(C.WAGE_MIDPOINT_PATTERN), _midpoint(amount(1), amount(2)))


def _plain_number(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(\d)", "$1")


def split_wage_info(text: Column, pattern: str = C.WAGE_TRIPLET_PATTERN) -> tuple[Column, Column]:
    """(wage_info, remaining text) of standardised text.

    A leading triplet of numbers (code, low, high) becomes `low-high` and leaves the
    text; otherwise a mention that the wage is to be agreed does, everywhere.
    """
    anchored = f"^(?:{pattern})"
    has_range = text.rlike(anchored)
    agreed = F.contains(F.lower(text), F.lit(C.TO_BE_AGREED))
    low, high = (_plain_number(F.regexp_extract(text, anchored, g)) for g in (2, 3))
    info = F.when(has_range, F.concat(low, F.lit("-"), high)).when(agreed, F.lit(C.TO_BE_AGREED))
    rest = (
        F.when(has_range, strip(F.regexp_replace(text, anchored, "")))
        .when(agreed, strip(F.regexp_replace(text, rf"(?i)\s*{C.TO_BE_AGREED}", "")))
        .otherwise(text)
    )
    return info, rest


def wage_bound(wage_info: Column, group: int, pattern: str = C.WAGE_LABEL_PATTERN) -> Column:
    """Lower (1) or upper (2) end of a `low-high` range as BIGINT."""
    return F.regexp_extract(wage_info, pattern, group).try_cast("bigint")


def wage_label(wage_info: Column, pattern: str = C.WAGE_LABEL_PATTERN) -> Column:
    low, high = (F.regexp_extract(wage_info, pattern, g) for g in (1, 2))
    return F.when(wage_info.rlike(pattern), _midpoint(low, high))


def log_wage(wage: Column) -> Column:
    return F.log(wage)
