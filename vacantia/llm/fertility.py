"""Quality rules on how well public vocabularies fit a text.

A byte-level vocabulary gives characters per token and the entropy of the tokens, a piece
vocabulary gives characters per piece and the share of single-byte pieces. Words with a
digit, which are numbers and keys and no words of a language, are left out of these and measured
by themselves: their share of the words and of the characters. A document is rejected if a
measure leaves the band of its language; bands come from all documents of the language. Documents
without a language are banded by their script.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import WORD, map_batches, strings, text_key
from vacantia.llm.tokens import ByteLevelTokens, PieceTokens, WordTable, in_groups, loaded
from vacantia.scratch import stage

# --- fixed values: the base rules ---
MIN_WORDS = 10
REPEAT_WINDOW = 5
MAX_REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"
# --- end of fixed values ---

# Half-width of a band in spreads (half the distance of the quartiles) of its group. A mean
# over n tokens scatters with 1 / sqrt(n), so a text of n tokens gets this much more.
BAND_WIDTH = {
    "token_chars": 1.5, "piece_chars": 1.5, "entropy": 4.0, "byte_share": 1.5,
    "digit_words": 2.0, "digit_chars": 2.0,
}
SHORT_TEXT_SLACK = 26.0
# The shares of words with a digit scatter with the number of words: a few words may well be a
# telephone number and a card.
FEW_WORDS_SLACK = 60.0
# The entropy is taken relative to that of so many different tokens at most: beyond, a text
# says nothing new about its vocabulary by being longer.
ENTROPY_TOKENS = 1024
# Measures are rounded to this grid before their quartiles are taken, which bounds the
# number of distinct values a language has.
GRID = 1 / 256
MIN_SPREAD = {
    "token_chars": 0.06, "piece_chars": 0.06, "entropy": 0.015, "byte_share": 0.02,
    "digit_words": 0.03, "digit_chars": 0.03,
}
_DIGIT = re.compile(r"[0-9]")


def repeated_words(words: list) -> int:
    """Words in windows of five that occur at least twice in the text."""
    windows = list(zip(*[words[i:] for i in range(REPEAT_WINDOW)]))
    counts: dict[tuple, int] = {}
    for window in windows:
        counts[window] = counts.get(window, 0) + 1
    inside, until = 0, 0
    for at, window in enumerate(windows):
        if counts[window] > 1:
            inside += at + REPEAT_WINDOW - max(at, until)
            until = at + REPEAT_WINDOW
    return inside


def _may_repeat(word: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Which texts have two windows of one hash; others repeat no window."""
    count = len(word) - REPEAT_WINDOW + 1
    found = np.zeros(texts, bool)
    if count > 0:
        mixed = np.zeros(count, np.uint64)
        for k in range(REPEAT_WINDOW):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + word[k : k + count].astype(np.uint64)
        mixed ^= mixed >> np.uint64(31)
        inside = text[:count] == text[REPEAT_WINDOW - 1 :]
        text, mixed = text[:count][inside], mixed[inside]
        order = np.lexsort((mixed, text))
        text, mixed = text[order], mixed[order]
        found[text[1:][(text[1:] == text[:-1]) & (mixed[1:] == mixed[:-1])]] = True
    return found


def repeated_lines(text: str) -> int:
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(lines) - len(set(lines))


def entropy(ids: np.ndarray) -> float:
    """Of the tokens' distribution, over the largest value for so many tokens."""
    total = len(ids)
    if total < 2:
        return 1.0
    ordered = np.sort(ids)
    counts = np.diff(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]])))
    shares = counts / total
    return float(-(shares * np.log(shares)).sum() / np.log(min(total, ENTROPY_TOKENS)))


class Fertility:
    """Per word: code points, those the vocabularies measure, its pieces and single-byte pieces,
    whether it has a digit, and the ids of the byte-level vocabulary."""

    def __init__(self, byte_path: str, piece_path: str):
        self.bytes, self.pieces = ByteLevelTokens(byte_path), PieceTokens(piece_path)
        self.table = WordTable(self._describe, "u4")

    def _describe(self, words: list[bytes]) -> list[tuple[tuple, list[int]]]:
        texts = [word.decode() for word in words]
        found = []
        for text, (pieces, fallback) in zip(texts, self.pieces.counts(texts)):
            if _DIGIT.search(text):
                found.append(((len(text), 0, 0, 0, 1), []))
            else:
                ids = self.bytes.ids(" " + text)
                found.append(((len(text), len(text), pieces, fallback, 0), ids))
        return found


def script(text: str) -> str:
    """The script of the text's first letter, as Unicode names it."""
    first = next(filter(str.isalpha, text), None)
    return "none" if first is None else unicodedata.name(first, "UNKNOWN").split(" ")[0].lower()


def measures(documents: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """doc_id, text_key, group, the base counts, and the vocabularies' measures."""
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens")
    names = ("token_chars", "piece_chars", "byte_share", "entropy", "digit_words", "digit_chars")

    def make(batch: pa.RecordBatch) -> dict:
        table = loaded(Fertility, byte_path, piece_path).table
        texts, langs = strings(batch, "text"), batch.column("lang").to_pylist()
        made: dict[str, list] = {k: [] for k in ("group", *counts, *names)}
        for own, words, ends in in_groups(texts, lambda text: text.encode().split()):
            at = table.of(words)
            starts = np.concatenate([[0], ends[:-1]])
            text = np.repeat(np.arange(len(own)), ends - starts)
            ids_at, word_ends = table.spread(at)
            ids = table.values[ids_at]
            id_ends = np.concatenate([[0], word_ends])
            numbers = table.numbers[at] if len(at) else np.zeros((0, 5), np.int64)
            sums = np.concatenate([np.zeros((1, 5), np.int64), np.cumsum(numbers, axis=0)])
            sums = (sums[ends] - sums[starts]).tolist()
            repeats = _may_repeat(at, text, len(own))
            for k, i in enumerate(own):
                chars, measured, pieces, fallback, with_digit = sums[k]
                tokens = ids[id_ends[starts[k]] : id_ends[ends[k]]]
                values = (
                    langs[i] if langs[i] is not None else f"script:{script(texts[i])}",
                    int(ends[k] - starts[k]), chars, sum(map(texts[i].count, SYMBOLS)),
                    repeated_lines(texts[i]), repeated_words(words[starts[k] : ends[k]]) if repeats[k] else 0,
                    len(tokens), measured / max(1, len(tokens)), measured / max(1, pieces),
                    fallback / max(1, pieces), entropy(tokens),
                    with_digit / max(1, int(ends[k] - starts[k])), (chars - measured) / max(1, chars),
                )
                for key, value in zip(made, values):
                    made[key].append(value)
        return made | {k: batch.column(k) for k in ("doc_id", "text_key")}

    schema = ", ".join(
        ["doc_id long, text_key long, group string"]
        + [f"{k} long" for k in counts]
        + [f"{k} double" for k in names]
    )
    rows = documents.select("doc_id", "text", "lang", text_key(documents).alias("text_key"))
    return map_batches(rows, schema, make)


def bands(measured: DataFrame) -> DataFrame:
    """Median and spread of each measure by group, over all documents that pass the base rules."""
    def quartiles(name: str) -> Column:
        rounded = F.round(F.col(name) / F.lit(GRID)) * F.lit(GRID)
        return F.percentile(rounded, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(name)

    found = measured.where(~F.col("base_failed")).groupBy("group")
    found = found.agg(*map(quartiles, MIN_SPREAD))
    columns = ["group"]
    for name, least in MIN_SPREAD.items():
        columns.append(F.col(name)[1].alias(f"{name}_middle"))
        columns.append(
            F.greatest((F.col(name)[2] - F.col(name)[0]) / 2, F.lit(least)).alias(f"{name}_spread")
        )
    return found.select(*columns)


def judge(documents: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Per row: doc_id, text_key, the base counts, base_failed, kept, and the measures.

    base_failed: under ten words, or over a fifth of them in repeated windows. Otherwise a
    document is kept unless its characters per token or per piece or its entropy lie below
    the band of its group, or its share of byte pieces, of words with a digit or of characters
    in these above it. Null and empty texts have
    no words and fail. Rows without doc_id are judged like others, repeated rows each. A
    column lang that is missing counts as null; other columns are not read.
    """
    if "lang" not in documents.columns:
        documents = documents.withColumn("lang", F.lit(None).cast("string"))
    failed = (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )
    measured = stage(
        measures(documents, byte_path, piece_path).withColumn("base_failed", failed), "measures"
    )
    tokens, words = F.greatest("n_tokens", F.lit(1)), F.greatest("n_words", F.lit(1))

    def reach(name: str) -> Column:
        slack = F.lit(SHORT_TEXT_SLACK) / F.sqrt(tokens)
        if name in ("digit_words", "digit_chars"):
            slack = F.lit(FEW_WORDS_SLACK) / F.sqrt(words)
        return (F.lit(BAND_WIDTH[name]) + slack) * F.col(f"{name}_spread")

    low = [
        F.col(name) < F.col(f"{name}_middle") - reach(name)
        for name in ("token_chars", "piece_chars", "entropy")
    ]
    high = [
        F.col(name) > F.col(f"{name}_middle") + reach(name)
        for name in ("byte_share", "digit_words", "digit_chars")
    ]
    # Without a word that the vocabularies measure only the shares say something.
    low = [(F.col("n_tokens") > 0) & below for below in low]
    outside = F.coalesce(reduce(or_, [*low, *high]), F.lit(False))
    # A row per language or script: written, so that its size is known before the join.
    limits = stage(bands(measured), "bands")
    return (
        measured.join(limits.withColumnRenamed("group", "band"), F.col("group") == F.col("band"), "left")
        .withColumn("kept", ~F.col("base_failed") & ~outside)
        .select(
            "doc_id", "text_key", "n_words", "word_chars", "n_symbols", "n_dup_lines",
            "n_repeat_words", "base_failed", "kept", "token_chars", "piece_chars",
            "byte_share", "entropy", "digit_words", "digit_chars",
        )
    )
