"""Personal data by patterns, and by contexts learnt from what the patterns find.

Base matches are seeds. The words around a seed form lexical patterns; a pattern's
confidence for a kind is the share of seeds of that kind among the identifiers it surrounds,
an identifier's that of the patterns it is seen in. Identifiers that score high become seeds
of the next round, and their occurrences are added to the spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import count

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import WORD, map_batches, strings, text_key
from vacantia.llm.spans import Covered, Span, sha256, written
from vacantia.scratch import stage

# --- fixed values: kinds and what a match must pass ---
KINDS = ("email", "ip", "card", "phone")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
MAX_IP_PART = 255
CARD_DIGITS = (14, 19)
PHONE_DIGITS = (10, 15)
# --- end of fixed values ---

MIN_SEEDS = 3
MIN_PATTERN_CONFIDENCE = 0.6
MIN_IDENTIFIER_SCORE = 0.8
CONTEXT_CHARS = 64
MIN_DIGITS = 4
_IDENTIFIER = re.compile(r"(?:[0-9@]|(?<=[^0-9A-Za-z])\([0-9])[A-Za-z0-9@._%+()/-]*+")
_IDENTIFIER_CHARS = LOCAL_CHARS | frozenset("@()/")
_GROUPS = re.compile(r"(?<![0-9A-Za-z@])\(?[0-9]++(?:(?:\) ?| \(?|[.-]\(?)[0-9]++)+(?![0-9A-Za-z@])")
_SEPARATORS = str.maketrans("", "", " -")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ takes the run of local characters before it, down to the last match's end."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", max(at + 1, last))


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; those that fail their test are dropped."""
    spans: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for found in IP.finditer(text):
        parts = [part.lstrip("0") for part in found.group().split(".")]
        if all(len(part) <= 3 and int(part or 0) <= MAX_IP_PART for part in parts):
            spans.append(("ip", *found.span()))
    for found in CARD.finditer(text):
        digits = found.group().translate(_SEPARATORS)
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            spans.append(("card", *found.span()))
    if "+" in text:
        for found in PHONE.finditer(text):
            if PHONE_DIGITS[0] <= sum(map(str.isdigit, found.group())) <= PHONE_DIGITS[1]:
                spans.append(("phone", *found.span()))
    return spans


def _fits(identifier: str) -> set[str]:
    """The kinds that an identifier's characters allow."""
    digits = sum(c.isdigit() for c in identifier)
    kinds = set()
    if "@" in identifier and not identifier.startswith("@") and not identifier.endswith("@"):
        kinds.add("email")
    elif digits >= MIN_DIGITS:
        if identifier.count(".") >= 3 and digits <= 12 and " " not in identifier:
            kinds.add("ip")
        if 12 <= digits <= 19:
            kinds.add("card")
        if 7 <= digits <= 15 and not any(c.isalpha() for c in identifier):
            kinds.add("phone")
    return kinds


def identifiers(text: str, spans: list[Span]) -> Iterator[tuple[int, int]]:
    """Runs of identifier characters, with a digit or @, and of groups of digits with single
    blanks or brackets between them, that meet no span."""
    covered, last = Covered(spans), 0
    for found in _IDENTIFIER.finditer(text):
        start, end = found.span()
        if start < last:
            continue
        while start > last and text[start - 1] in _IDENTIFIER_CHARS:
            start -= 1
        last = end
        while end > start and text[end - 1] in ".(+%/-":
            end -= 1
        while start < end and text[start] in ".)%/-":
            start += 1
        if 5 <= end - start and not covered.meets(start, end):
            yield start, end
    for found in _GROUPS.finditer(text):
        if " " in found.group() and not covered.meets(*found.span()):
            yield found.span()


def contexts(text: str, start: int, end: int) -> list[int]:
    """Hashes of the two words before, and of the words on both sides."""
    before = WORD.findall(text[max(0, start - CONTEXT_CHARS) : start].lower())[-2:]
    after = WORD.findall(text[end : end + CONTEXT_CHARS].lower())[:1]
    found = []
    if len(before) == 2:
        found.append("before\n" + "\n".join(before))
    if before and after:
        found.append(f"around\n{before[-1]}\n{after[0]}")
    return [xxhash.xxh64_intdigest(pattern) - (1 << 63) for pattern in found]


_MENTION = "struct<kind:string,start:int,end:int,identifier:long,patterns:array<long>>"


def find(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, text_key, the base counts and spans, and `mentions`: base matches and
    other identifiers (kinds they may be) with their contexts."""

    def make(batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {
            k: [] for k in (*(f"n_{kind}" for kind in KINDS), "base", "mentions")
        }
        for text in strings(batch, "text"):
            spans = base_spans(text)
            for kind in KINDS:
                made[f"n_{kind}"].append(sum(span[0] == kind for span in spans))
            made["base"].append(written(spans, KINDS))
            mentions = [(f"seed:{kind}", start, end) for kind, start, end in spans]
            for start, end in identifiers(text, spans):
                mentions += [(kind, start, end) for kind in sorted(_fits(text[start:end]))]
            made["mentions"].append([
                {
                    "kind": kind, "start": start, "end": end,
                    "identifier": xxhash.xxh64_intdigest(text[start:end].lower()) - (1 << 63),
                    "patterns": contexts(text, start, end),
                }
                for kind, start, end in mentions
            ])
        return made | {k: batch.column(k) for k in ("doc_id", "text_key")}

    counts = ", ".join(f"n_{kind} long" for kind in KINDS)
    schema = f"doc_id long, text_key long, {counts}, base string, mentions array<{_MENTION}>"
    rows = documents.select("doc_id", "text", text_key(documents).alias("text_key"))
    return map_batches(rows, schema, make)


def bootstrap(mentions: DataFrame, rounds: int | None = None) -> DataFrame:
    """(kind, identifier, patterns) of mentions -> (kind, identifier) found by context.

    Scores run over distinct (pattern, identifier) pairs, so a copied text counts once. A
    pattern counts for a kind with at least MIN_SEEDS different seeds around which it stood;
    its confidence is their weight over all its identifiers and one. An identifier's score is
    one minus the product of its patterns' doubts. Rounds go on until one adds no identifier,
    or as many as given: seeds only gain weight, so an identifier found stays found.
    """
    pairs = stage(
        mentions.select(
            F.regexp_replace("kind", "^seed:", "").alias("kind"),
            F.col("kind").startswith("seed:").alias("seed"),
            "identifier",
            F.explode("patterns").alias("pattern"),
        )
        .groupBy("pattern", "identifier", "kind")
        .agg(F.bool_or("seed").alias("seed")),
        "pairs",
    )
    everything = pairs.groupBy("pattern").agg(F.countDistinct("identifier").alias("identifiers"))
    known = pairs.select("kind", "identifier", "pattern", F.when(F.col("seed"), 1.0).alias("weight"))
    found = None
    before = 0
    for _ in count() if rounds is None else range(rounds):
        patterns = (
            known.where(F.col("weight").isNotNull())
            .groupBy("pattern", "kind")
            .agg(F.count("*").alias("seeds"), F.sum("weight").alias("weight"))
            .where(F.col("seeds") >= MIN_SEEDS)
            .join(everything, "pattern")
            .withColumn("confidence", F.col("weight") / (F.col("identifiers") + 1))
            .where(F.col("confidence") >= MIN_PATTERN_CONFIDENCE)
            .select("pattern", "kind", "confidence")
        )
        # Doubts are summed as whole numbers, so that no order of adding shows in a score.
        doubt = F.round(F.log(1 - F.least(F.col("confidence"), F.lit(0.999))) * 1e9).cast("long")
        found = stage(
            pairs.where(~F.col("seed"))
            .join(patterns, ["pattern", "kind"])
            .groupBy("kind", "identifier")
            .agg((1 - F.exp(F.sum(doubt) / 1e9)).alias("score"))
            .where(F.col("score") >= MIN_IDENTIFIER_SCORE),
            "identifiers",
        )
        size = found.count()
        if size == before:
            break
        before = size
        known = pairs.join(found, ["kind", "identifier"], "left").select(
            "kind", "identifier", "pattern",
            F.when(F.col("seed"), 1.0).otherwise(F.col("score")).alias("weight"),
        )
    # An identifier that could be several kinds takes the one with the best score.
    best = F.min_by("kind", F.struct(-F.col("score"), "kind"))
    return found.groupBy("identifier").agg(best.alias("kind")).select("kind", "identifier")


def _outermost(spans: list[Span]) -> list[Span]:
    """Without spans inside another one: a run may be a part of groups of digits."""
    kept, last = [], 0
    for span in sorted(spans, key=lambda s: (s[1], -s[2])):
        if span[2] > last:
            kept.append(span)
            last = span[2]
    return kept


def personal_data(documents: DataFrame, rounds: int | None = None) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base matches, and
    spans: base matches with what the contexts add.

    Null and empty texts have no spans. Rows without doc_id are searched like others,
    repeated rows each; contexts count a text's copies once. Other columns are not read.
    """
    found = stage(find(documents), "personal")
    mentions = found.select("doc_id", "text_key", F.explode("mentions").alias("m")).select(
        "doc_id", "text_key", "m.*"
    )
    learnt = bootstrap(mentions, rounds)
    added = (
        mentions.where(~F.col("kind").startswith("seed:"))
        .join(learnt, ["kind", "identifier"])
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    )
    joined = found.drop("mentions").alias("f").join(
        added.alias("a"),
        F.col("f.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("f.text_key") == F.col("a.text_key")),
        "left",
    ).select("f.*", "added")

    def make(batch: pa.RecordBatch) -> dict:
        bases = batch.column("base").to_pylist()
        spans = []
        for base, added_spans in zip(bases, batch.column("added").to_pylist()):
            own = [s.split(":") for s in base.split(",") if s]
            every = [(kind, int(a), int(b)) for kind, a, b in own]
            every += _outermost([(s["kind"], s["start"], s["end"]) for s in added_spans or ()])
            spans.append(written(every, KINDS))
        counts = {f"n_{kind}": batch.column(f"n_{kind}") for kind in KINDS}
        return counts | {
            "doc_id": batch.column("doc_id"), "base_sha256": map(sha256, bases), "spans": spans,
        }

    schema = ", ".join(["doc_id long", *(f"n_{kind} long" for kind in KINDS)])
    return map_batches(joined, f"{schema}, base_sha256 string, spans string", make)
