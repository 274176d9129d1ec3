"""Array expressions over the words of one listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import constants as C
from vacantia.functions.text import split_words


def tokens(text: Column, pattern: str | None = C.TOKEN_PATTERN) -> Column:
    """Lower-case words that match the pattern; every word without a pattern."""
    words = split_words(F.lower(text))
    if pattern is None:
        return words
    return F.filter(words, lambda w: w.rlike(pattern))


def _without_ends(words: Column, start: int) -> Column:
    return F.slice(words, start, F.greatest(F.size(words) - 1, F.lit(0)))


def neighbour_structs(words: Column) -> Column:
    """Array of (first, second) structs of neighbouring words."""
    return F.arrays_zip(_without_ends(words, 1), _without_ends(words, 2))
