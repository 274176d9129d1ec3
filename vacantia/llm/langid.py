"""Language of a text: first its family, then the language within the family.

Both steps are linear support vector machines on hashed character n-grams: one per family
against the others, then one for each pair of languages of a family, whose votes decide.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.chars import CODE_POINTS, LETTER, CharTables, code_points
from vacantia.llm.common import map_batches, strings
from vacantia.llm.tokens import loaded

# --- fixed values: families of language codes, and the folds ---
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "gd", "cy", "br"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "iranian": ("fa", "ps", "ku", "tg"),
    "indic": ("hi", "bn", "ur", "mr", "gu", "pa", "ne", "si"),
    "semitic": ("ar", "he", "am", "mt"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "austronesian": ("id", "ms", "tl", "jv"),
}
FOLDS, HELD_OUT_FOLD = 4, 2
UNDETERMINED = "und"
# --- end of fixed values ---

DIMENSIONS = 4096
ORDERS = (1, 2, 3)
# The sample to fit on: so many texts per language at most, and in all.
SAMPLE_PER_LANGUAGE = 400
SAMPLE_TOTAL = 6000
MAX_LANGUAGES = 400
STEPS = 150
PENALTY = 1e-4
CHARS_AT_ONCE = 1 << 20
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def family(language: str) -> str:
    """The family of a code; a language outside the list is a family of its own."""
    return next((name for name, codes in FAMILIES.items() if language in codes), language)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of unit length per text, and whether the text has a letter. Letters count in
    lower case; what is between words counts as one space."""
    rows = np.zeros((len(texts), DIMENSIONS), np.float32)
    lettered = np.zeros(len(texts), bool)
    tables = loaded(CharTables)
    for i, text in enumerate(texts):
        counts = np.zeros(DIMENSIONS, np.int64)
        overlap = np.empty(0, np.uint32)
        for at in range(0, len(text), CHARS_AT_ONCE):
            part = text[at : at + CHARS_AT_ONCE]
            points = code_points(part)
            letter = tables.kinds[points] == LETTER
            lower = tables.lower[points]
            for place in np.flatnonzero(points == CODE_POINTS - 1):
                # The tables end here; rare letters beyond stand for themselves.
                letter[place] = part[place].isalpha()
                lower[place] = ord(part[place])
            lettered[i] |= letter.any()
            symbols = np.where(letter, lower, 32).astype(np.uint32)
            again = np.concatenate([[False], (symbols[1:] == 32) & (symbols[:-1] == 32)])
            symbols = np.concatenate([overlap, symbols[~again]])
            for order in ORDERS:
                count = len(symbols) - order + 1
                if count > 0:
                    mixed = np.full(count, order, np.uint32)
                    for k in range(order):
                        mixed = (mixed ^ symbols[k : k + count]) * _MULTIPLIERS[k]
                        mixed ^= mixed >> np.uint32(15)
                    counts += np.bincount(mixed % DIMENSIONS, minlength=DIMENSIONS)
            overlap = symbols[len(symbols) - max(ORDERS) + 1 :]
        row = np.sqrt(counts)
        rows[i] = row / (np.linalg.norm(row) or 1.0)
    return rows, lettered


def linear_svm(rows: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the squared hinge loss with an L2 penalty, by
    accelerated gradient steps; both classes weigh the same."""
    inputs = np.hstack([rows, np.ones((len(rows), 1), np.float32)])
    share = np.where(signs > 0, 0.5 / max(1, (signs > 0).sum()), 0.5 / max(1, (signs < 0).sum()))
    share = share.astype(np.float32)
    weights = np.zeros(inputs.shape[1], np.float32)
    ahead, momentum = weights.copy(), 1.0
    rate = 1.0 / (2 * 2.0 + PENALTY)  # rows have norm 2 at most with the bias
    for _ in range(STEPS):
        slack = np.maximum(0, 1 - signs * (inputs @ ahead))
        gradient = PENALTY * ahead - 2 * inputs.T @ (share * signs * slack)
        stepped = ahead - rate * gradient
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = stepped + (momentum - 1) / following * (stepped - weights)
        weights, momentum = stepped, following
    return weights[:-1], float(weights[-1])


class Hierarchy:
    """Family machines, then pairwise machines within a family."""

    def __init__(self, rows: np.ndarray, languages: list[str]):
        self.languages = sorted(set(languages))
        of = np.array(languages)
        families = np.array([family(language) for language in languages])
        self.families = sorted(set(families))
        self.members = {
            name: [code for code in self.languages if family(code) == name] for name in self.families
        }
        machines = [
            linear_svm(rows, np.where(families == name, 1.0, -1.0).astype(np.float32))
            for name in self.families
        ] if len(self.families) > 1 else []
        self.family_machines = machines
        self.pairs = {}
        for name in self.families:
            for one, other in combinations(self.members[name], 2):
                both = (of == one) | (of == other)
                signs = np.where(of[both] == one, 1.0, -1.0).astype(np.float32)
                self.pairs[one, other] = linear_svm(rows[both], signs)

    def predict(self, rows: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Languages and scores in 0..1: how sure the family and the closest vote are."""
        margins = np.column_stack(
            [rows @ w + b for w, b in self.family_machines] or [np.ones(len(rows))]
        )
        chosen = margins.argmax(axis=1)
        sure = 1 / (1 + np.exp(-4 * margins.max(axis=1)))
        found, scores = [""] * len(rows), np.zeros(len(rows))
        for k, name in enumerate(self.families):
            at = np.flatnonzero(chosen == k)
            codes = self.members[name]
            votes = np.zeros((len(at), len(codes)))
            weakest = np.full((len(at), len(codes)), np.inf)
            for i, j in combinations(range(len(codes)), 2):
                w, b = self.pairs[codes[i], codes[j]]
                margin = rows[at] @ w + b
                # A vote is one; the margins, far below one in sum, only break ties.
                lean = 1e-3 * np.tanh(margin)
                votes[:, i] += (margin >= 0) + lean
                votes[:, j] += (margin < 0) - lean
                weakest[:, i] = np.minimum(weakest[:, i], margin)
                weakest[:, j] = np.minimum(weakest[:, j], -margin)
            best = votes.argmax(axis=1)
            closeness = 1 / (1 + np.exp(-4 * weakest[np.arange(len(at)), best]))
            for row, code, score in zip(at, best, sure[at] * closeness):
                found[row], scores[row] = codes[code], score
        return found, np.clip(scores, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """Whether the document is kept from learning; a document without id isn't."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % FOLDS
    return F.coalesce(fold == HELD_OUT_FOLD, F.lit(False))


def fit(
    documents: DataFrame,
    per_language: int | None = None,
    total: int | None = None,
    max_languages: int | None = None,
) -> Hierarchy | None:
    """Learn from (text, lang) of documents that aren't held out and whose lang isn't null.

    The sample is bounded: per language about as many texts as the parameters say, those
    with the smallest hash of the text, found by a threshold from the language's exact count of
    different hashes, so copies don't thin a sample and no text is moved to choose it. Texts
    without a letter teach nothing. Of more than `max_languages` languages, which bounds the
    sample too, those with the most different texts are learnt, by name if equal. None if no
    document has a language.
    """
    some = documents.where(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    ).select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(1 << 40)).alias("h"))
    distinct = some.select("lang", "h").distinct().groupBy("lang").count()
    counted = distinct.orderBy(F.desc("count"), "lang").limit(max_languages or MAX_LANGUAGES).collect()
    if not counted:
        return None
    size = max(
        8, min(per_language or SAMPLE_PER_LANGUAGE, (total or SAMPLE_TOTAL) // len(counted))
    )
    limits = {row["lang"]: int(min(1.0, size / row["count"]) * (1 << 40)) for row in counted}
    limit = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])[F.col("lang")]

    def make(batch: pa.RecordBatch) -> dict:
        rows, lettered = features(strings(batch, "text"))
        return {
            "lang": batch.column("lang"), "h": batch.column("h"), "lettered": lettered,
            "row": [row.astype(np.float16).tobytes() for row in rows],
        }

    sample = map_batches(
        some.where(F.col("h") < limit), "lang string, h long, lettered boolean, row binary", make
    )
    # A hash may hold many copies of a text: one of each is enough.
    sample = sample.where("lettered").groupBy("lang", "h").agg(F.first("row").alias("row"))
    taken = sorted((r["lang"], r["h"], bytes(r["row"])) for r in sample.collect())
    if not taken:
        return None
    rows = np.frombuffer(b"".join(r for _, _, r in taken), np.float16)
    return Hierarchy(rows.reshape(len(taken), -1).astype(np.float32), [l for l, _, _ in taken])


def identify(documents: DataFrame, **sample: int) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score. `sample` goes to `fit`.

    The language is one of those learnt; `und` with score 0 if the text is null, has no
    letter, or nothing could be learnt. Rows without doc_id are not held out. Repeated rows
    are returned as often as they come. Only doc_id, text and lang are read, lang only to
    learn.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, **sample))

    def make(batch: pa.RecordBatch) -> dict:
        names, scores = [], []
        texts = strings(batch, "text")
        for first in range(0, len(texts), 512):
            rows, lettered = features(texts[first : first + 512])
            if model.value is None:
                found, sure = [UNDETERMINED] * len(rows), np.zeros(len(rows))
            else:
                found, sure = model.value.predict(rows)
            names += [name if has else UNDETERMINED for name, has in zip(found, lettered)]
            scores += np.where(lettered, sure, 0.0).tolist()
        return {
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
            "lang_pred": names, "score": scores,
        }

    rows = documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return map_batches(rows, "doc_id long, held_out boolean, lang_pred string, score double", make)
