"""Text normalisation as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vacantia import constants as C

# Members of a character class. UNICODE_SPACE is every code point that counts as
# white space in a str; Java's own \s knows only part of the ASCII ones.
ASCII_SPACE = r"\t-\r\x1c-\x20"
UNICODE_SPACE = (
    ASCII_SPACE + r"\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

TextStep = Callable[[Column], Column]


@lru_cache(maxsize=None)
def _letter_map(keep_non_ascii: bool) -> tuple[str, str]:
    """Source and target strings for `translate`: each composed letter that canonical
    decomposition reduces to exactly one other character, and that character."""
    source, target = [], []
    for point in range(0x80, 0x110000):
        letter = chr(point)
        parts = unicodedata.normalize("NFD", letter)
        if parts == letter:
            continue
        if keep_non_ascii:
            base = [p for p in parts if unicodedata.category(p) != "Mn"]
        else:
            base = [p for p in parts if p.isascii()]
        if len(base) == 1 and base[0] != letter:
            source.append(letter)
            target.append(base[0])
    return "".join(source), "".join(target)


@lru_cache(maxsize=None)
def _other_spaces() -> str:
    return "".join(chr(p) for p in range(0x110000) if chr(p).isspace() and chr(p) != " ")


def lowercase(text: Column) -> Column:
    return F.lower(text)


def remove_accents(text: Column) -> Column:
    """Drop combining marks, keep every other character (also non-ASCII ones)."""
    return F.regexp_replace(F.translate(text, *_letter_map(True)), r"\p{Mn}", "")


def ascii_fold(text: Column) -> Column:
    """Drop accents and then every character that is still not ASCII."""
    return F.regexp_replace(F.translate(text, *_letter_map(False)), r"[^\x00-\x7f]", "")


def keep_alphanumeric(text: Column) -> Column:
    return F.regexp_replace(text, f"[^a-zA-Z0-9{UNICODE_SPACE}]", "")


def squeeze_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"[{UNICODE_SPACE}]+", " "))


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of any kind."""
    return F.btrim(text, F.lit(" " + _other_spaces()))


def flatten_lines(text: Column) -> Column:
    """One listing per line: inner line breaks become spaces."""
    return F.translate(text, "\n\r", "  ")


DEFAULT_STEPS: tuple[TextStep, ...] = (lowercase, ascii_fold, keep_alphanumeric, squeeze_spaces)


@lru_cache(maxsize=None)
def _standard_map() -> tuple[str, str]:
    """Letters to their ASCII base, ASCII white space to spaces, and the rest of ASCII to
    nothing: `translate` drops source characters that have no counterpart."""
    letters, bases = _letter_map(False)
    kept = [(x, y) for x, y in zip(letters, bases) if y.isalnum()]
    spaces = [chr(p) for p in (*range(0x09, 0x0E), *range(0x1C, 0x20))]
    source = "".join(x for x, _ in kept) + "".join(spaces)
    target = "".join(y for _, y in kept) + " " * len(spaces)
    other = [chr(p) for p in range(0x80) if not chr(p).isalnum() and chr(p) not in (" ", *spaces)]
    return source + "".join(other), target


def _default_standard(text: Column) -> Column:
    # Same result as folding DEFAULT_STEPS. One pass does nearly all of the work; the
    # regular expressions run only on rows with other scripts or repeated spaces.
    mapped = F.translate(F.lower(text), *_standard_map())
    ascii_only = F.octet_length(mapped) == F.char_length(mapped)
    kept = F.when(ascii_only, mapped).otherwise(F.regexp_replace(mapped, "[^a-zA-Z0-9 ]+", ""))
    squeezed = F.when(F.contains(kept, F.lit("  ")), F.regexp_replace(kept, " {2,}", " "))
    return F.trim(squeezed.otherwise(kept))


def standardize(text: Column, steps: Sequence[TextStep] | None = None) -> Column:
    if steps is None:
        return _default_standard(text)
    return reduce(lambda column, step: step(column), steps, text)


def listing_code(raw: Column, pattern: str = C.CODE_PATTERN) -> Column:
    """Leading digit run of a raw line, NULL where there is none."""
    return F.nullif(F.regexp_extract(raw, pattern, 0), F.lit(""))


def contains_keyword(text: Column, keyword: str) -> Column:
    return F.contains(F.lower(text), F.lit(keyword.lower()))


def _with_plain_spaces(text: Column) -> Column:
    """Every white-space character as a space; runs stay runs."""
    other = _other_spaces()
    # Nearly all text is ASCII without any of these, which is found out faster than by a pattern.
    among_ascii = [F.contains(text, F.lit(space)) for space in other if space.isascii()]
    plain = (F.octet_length(text) == F.char_length(text)) & ~reduce(Column.__or__, among_ascii)
    odd = ~plain & text.rlike(f"[{other}]")
    return F.when(odd, F.translate(text, other, " " * len(other))).otherwise(text)


def split_words(text: Column) -> Column:
    """White-space separated words; empty text has none."""
    return F.filter(F.split(_with_plain_spaces(text), " "), lambda w: w != "")


def spaced_lower(text: Column) -> Column:
    """Lower-case text to be split at single spaces for a vocabulary lookup. Pieces may
    be empty, which no known word is."""
    return _with_plain_spaces(F.lower(text))


def standard_words(text: Column) -> Column:
    """Words of standardised text, which has single inner spaces and no outer ones."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))
