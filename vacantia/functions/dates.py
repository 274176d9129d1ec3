"""Date expressions. Weekdays count from Monday = 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import constants as C

FRIDAY = 4


def publication_date(raw: Column, pattern: str = C.PUBLICATION_PATTERN) -> Column:
    """First publication date of a raw line, day first; NULL if absent or impossible."""
    found = F.nullif(F.regexp_extract(raw, pattern, 1), F.lit(""))
    return F.try_to_date(found, C.PUBLICATION_FORMAT)


def last_friday(day: Column) -> Column:
    """The Friday on or before a day."""
    return F.date_sub(day, F.pmod(F.weekday(day) - FRIDAY, F.lit(7)))


def next_friday(day: Column) -> Column:
    """The Friday on or after a day."""
    return F.date_add(day, F.pmod(F.lit(FRIDAY) - F.weekday(day), F.lit(7)))
