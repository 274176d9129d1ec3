"""Benchmark passages in documents, also with changed numbers, names and units.

Numbers, names and units of an item are slots, which any word or name of a document may fill,
a number only a number. Windows of the canonical words are joined by hash with the
benchmark's; windows with changed values count along alignments of a document with an item
on which a name of the item stands for one name of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.llm.chars import DIGIT, END, LETTER, LONG_WORD, OTHER, CharTables, code_points
from vacantia.llm.common import map_batches, strings, text_key
from vacantia.llm.tokens import loaded
from vacantia.scratch import stage

WINDOW = 5
MIN_LITERALS = 3
MIN_SHARE = 0.8
FILTER_BITS = 24

# --- fixed values: units, after a number ---
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams ounce ounces lb "
    "pound pounds ton tons ml l liter liters litre litres second seconds minute minutes hour "
    "hours day days week weeks month months year years dollar dollars cent cents euro euros "
    "degree degrees percent meter meters metre metres kilometer kilometers kilometre kilometres "
    "kilogram kilograms mph kmh watt watts volt volts".split()
)
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety "
    "hundred thousand million billion dozen half".split()
)
# --- end of fixed values ---
LITERAL, NUMBER, UNIT, NAME = range(4)
_MARKS = {NUMBER: "n:", UNIT: "u:", NAME: "a:"}
_SLOT = np.uint64(xxhash.xxh64_intdigest("<SLOT>"))
_FACTORS = np.array([xxhash.xxh64_intdigest(bytes([k])) | 1 for k in range(WINDOW)], np.uint64)
_SLOTS = _SLOT * _FACTORS
_UNIT_LENGTH = max(map(len, UNITS))
_SHIFTS = (64 - FILTER_BITS, 64 - 2 * FILTER_BITS)
CHARS_AT_ONCE = 1 << 20


def _layouts() -> list[list[tuple[int, int, bool]]]:
    """How a document's words may lie in a window: per place, the first word, the number of
    words and whether it is a slot. A slot between others may be a name of two words; at an
    edge, the window starts or ends inside such a name."""
    made = []
    for slots in product([False, True], repeat=WINDOW):
        if sum(slots) <= WINDOW - MIN_LITERALS:
            inner = [(1, 2) if slot and 0 < k < WINDOW - 1 else (1,) for k, slot in enumerate(slots)]
            for widths in product(*inner):
                made.append([(sum(widths[:k]), widths[k], slots[k]) for k in range(WINDOW)])
    return made


LAYOUTS = _layouts()


def canonical(texts: list[str]) -> Iterator[tuple]:
    """For some texts at once, until all are done: their characters in one string, and for
    each word the place of its text, its place in the text, where it starts and ends in the
    string, the hash of its lower case, and its kind as far as it stands alone.

    Digits and number words are numbers; a run of number words, also after digits, is one
    word. A word of the list after a number is a unit, a word with a capital that doesn't
    start a sentence or line a name. Other words are runs of letters; in scripts that are written
    without spaces, each letter is one.
    """
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and size < CHARS_AT_ONCE:
            size += len(texts[last]) + 1
            last += 1
        joined = "\n".join(texts[first:last]) + "\n"
        yield joined, *_canonical_words(joined, [len(t) for t in texts[first:last]], first)
        first = last


def _word_hashes(tables: CharTables, points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of words that follow each other in `points`."""
    firsts = np.cumsum(sizes) - sizes
    inside = np.arange(len(points)) - np.repeat(firsts, sizes)
    chars = tables.lower[points].astype(np.uint64)
    hashes = np.add.reduceat((chars + 1) * tables.powers[inside % LONG_WORD], firsts)
    hashes ^= hashes >> np.uint64(32)
    return hashes * _FACTORS[0]


class NumberWords:
    """Sorted hashes of the number words."""

    def __init__(self) -> None:
        sizes = np.array([len(w) for w in NUMBER_WORDS])
        self.hashes = np.sort(_word_hashes(loaded(CharTables), code_points("".join(NUMBER_WORDS)), sizes))

    def among(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return self.hashes[at] == hashes


def _canonical_words(joined: str, lengths: list[int], first: int) -> tuple[np.ndarray, ...]:
    tables = loaded(CharTables)
    points = code_points(joined)
    kinds = tables.kinds[points]
    mark = np.flatnonzero((points == ord(".")) | (points == ord(",")))
    mark = mark[(mark > 0) & (mark < len(points) - 1)]
    kinds[mark[(kinds[mark - 1] == DIGIT) & (kinds[mark + 1] == DIGIT)]] = DIGIT
    alone = (kinds == LETTER) & tables.spaceless[points]
    starts = np.concatenate([[0], np.flatnonzero((kinds[1:] != kinds[:-1]) | alone[1:] | alone[:-1]) + 1])
    ends = np.concatenate([starts[1:], [len(points)]])
    kind = kinds[starts]
    starts, ends, kind = starts[kind != OTHER], ends[kind != OTHER], kind[kind != OTHER]
    before = np.concatenate([[END], kind[:-1]])
    word = kind != END
    starts, ends, kind, before = starts[word], ends[word], kind[word], before[word]
    sizes = ends - starts
    if not len(starts):
        empty = np.empty(0, np.int64)
        return empty, empty, starts, ends, np.empty(0, np.uint64), np.empty(0, np.uint8)
    firsts = np.cumsum(sizes) - sizes
    own = points[np.repeat(starts - firsts, sizes) + np.arange(sizes.sum())]
    hashes = _word_hashes(tables, own, sizes)
    capital = np.add.reduceat(tables.upper[own], firsts, dtype=np.int64) > 0
    text_starts = np.concatenate([[0], np.cumsum(np.array(lengths) + 1)[:-1]])
    text = np.searchsorted(text_starts, starts, side="right") - 1

    spelt = (kind == LETTER) & loaded(NumberWords).among(hashes)
    number = (kind == DIGIT) | spelt
    gap = points[ends[:-1]]
    on = np.zeros(len(starts), bool)
    on[1:] = spelt[1:] & number[:-1] & (text[1:] == text[:-1]) & (starts[1:] - ends[:-1] == 1)
    on[1:] &= (gap == ord(" ")) | (gap == ord("-")) | (gap == ord("\n"))
    heads = np.flatnonzero(~on)
    hashes = np.add.reduceat(np.where(on, hashes * _FACTORS[1], hashes), heads)
    ends = ends[np.concatenate([heads[1:], [len(starts)]]) - 1]
    starts, kind, before, capital, number, text = (
        x[heads] for x in (starts, kind, before, capital, number, text)
    )

    after_number = np.concatenate([[False], number[:-1]]) & (before != END)
    unit = (kind == LETTER) & ~number & after_number & (ends - starts <= _UNIT_LENGTH)
    for i in np.flatnonzero(unit):
        unit[i] = joined[starts[i] : ends[i]].lower() in UNITS
    name = (kind == LETTER) & capital & (before != END) & ~number & ~unit
    kinds = np.select([number, unit, name], [NUMBER, UNIT, NAME], LITERAL).astype(np.uint8)
    place = np.arange(len(text)) - np.searchsorted(text, np.arange(len(lengths)))[text]
    return text + first, place, starts, ends, hashes, kinds


def _words(joined: str, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """Words in lower case; those of a spelt number are parted by one space."""
    return [joined[a:b].lower().replace("-", " ").replace("\n", " ") for a, b in zip(starts.tolist(), ends.tolist())]


def _mixed(mixed: np.ndarray) -> np.ndarray:
    mixed = mixed ^ (mixed >> np.uint64(29))
    return mixed * _FACTORS[0]


def _short(hashes: np.ndarray) -> np.ndarray:
    """Hashes of runs of fewer words than a window; a row for each place in the run."""
    size = len(hashes)
    return _mixed((hashes * _FACTORS[:size, None]).sum(axis=0, dtype=np.uint64) + _SLOTS[size])


def _parted(points: np.ndarray, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether more than a blank stands before each word, or its text starts there; and, one
    place further, whether the last text ends."""
    marks = np.concatenate([[0], np.cumsum((points != ord(" ")) & (points != ord("\t")))])
    parted = np.ones(len(starts) + 1, bool)
    parted[1:-1] = (marks[starts[1:]] > marks[ends[:-1]]) | (text[1:] != text[:-1])
    return parted


_WINDOW_SCHEMA = "text_key long, window long, place long, words string, slots array<string>"


def _names(benchmark: DataFrame) -> tuple[set[str], set[str]]:
    """Words of the benchmark that are names at every place, since more often than in lower
    case they have a capital inside a sentence; and those that may be, which only start
    sentences and never are in lower case. Texts with capitals on most words, or on none,
    don't count."""

    def make(batch: pa.RecordBatch) -> dict:
        counts: dict[str, list[int]] = {}
        for text in strings(batch, "text"):
            for joined, _, _, starts, ends, _, kinds in canonical([text]):
                at = np.flatnonzero((kinds == LITERAL) | (kinds == NAME))
                raw = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
                capitals = [w != w.lower() for w in raw]
                if not 0 < 2 * sum(capitals) <= len(raw):
                    continue
                for word, capital, kind in zip(raw, capitals, kinds[at].tolist()):
                    own = counts.setdefault(word.lower(), [0, 0, 0])
                    own[0 if kind == NAME else 1 if capital else 2] += 1
        made = list(zip(*counts.values())) or [(), (), ()]
        return {"word": list(counts), "inside": made[0], "initial": made[1], "low": made[2]}

    counted = (
        map_batches(benchmark.select("text"), "word string, inside long, initial long, low long", make)
        .groupBy("word")
        .agg(*[F.sum(c).alias(c) for c in ("inside", "initial", "low")])
        .where((F.col("inside") > F.col("low")) | ((F.col("inside") + F.col("low") == 0)))
        .select("word", (F.col("inside") > 0).alias("sure"))
        .collect()
    )
    return {r["word"] for r in counted if r["sure"]}, {r["word"] for r in counted if not r["sure"]}


def _item_words(text: str, names: set[str], perhaps: set[str]) -> tuple[list[str], np.ndarray, list[int], list[bool]]:
    """Words, hashes and kinds of an item, a run of names as one; and which may be no name."""
    parts = list(canonical([text]))
    if not parts:
        return [], np.empty(0, np.uint64), [], []
    joined, _, _, starts, ends, hashes, kinds = parts[0]
    words, kept, found, unsure = [], [], [], []
    for k, word in enumerate(_words(joined, starts, ends)):
        kind, maybe = int(kinds[k]), False
        if kind in (LITERAL, NAME):
            maybe = word in perhaps and joined[starts[k]].isupper()
            kind = NAME if maybe or word in names else LITERAL
        parted = k and joined[ends[k - 1] : starts[k]].strip()
        if kind == NAME and found and found[-1] == NAME and not parted and not unsure[-1] and not maybe:
            words[-1] += " " + word
            continue
        words.append(word)
        kept.append(hashes[k])
        found.append(kind)
        unsure.append(maybe)
    return words, np.array(kept, np.uint64), found, unsure


def _window_kinds(kinds: list[int], unsure: list[bool], place: int) -> list[int]:
    """Kinds of a window's words; what may be no name is none if else too few are literal."""
    own = kinds[place : place + WINDOW]
    if own.count(LITERAL) >= MIN_LITERALS:
        return own
    return [LITERAL if u else k for k, u in zip(own, unsure[place : place + WINDOW])]


def _item_windows(benchmark: DataFrame) -> DataFrame:
    """Windows of each item with enough literal words. Their slots take any word. An item
    without one has all its windows, without slots; of fewer words than a window, itself."""
    shared = benchmark.sparkSession.sparkContext.broadcast(_names(benchmark))

    def make(batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {k: [] for k in ("item_id", "text_key", "window", "place", "words", "slots")}
        ids, keys = (batch.column(c).to_pylist() for c in ("item_id", "text_key"))
        for item, key, text in zip(ids, keys, strings(batch, "text")):
            words, hashes, kinds, unsure = _item_words(text, *shared.value)
            owns = [_window_kinds(kinds, unsure, p) for p in range(len(words) - WINDOW + 1)]
            regular = [own.count(LITERAL) >= MIN_LITERALS for own in owns]
            if not any(regular):
                words, hashes = _item_words(text, set(), set())[:2]
                if 0 < len(words) < WINDOW:
                    made["item_id"].append(item)
                    made["text_key"].append(key)
                    made["window"] += _short(hashes[:, None]).view(np.int64).tolist()
                    made["place"].append(0)
                    made["words"].append(" ".join(words))
                    made["slots"].append([])
                owns = [[LITERAL] * WINDOW] * (len(words) - WINDOW + 1)
                regular = [True] * len(owns)
            for p in np.flatnonzero(regular).tolist():
                own = owns[p]
                part = np.where(np.array(own) == LITERAL, hashes[p : p + WINDOW], _SLOT) * _FACTORS
                made["item_id"].append(item)
                made["text_key"].append(key)
                made["window"] += _mixed(part.sum(keepdims=True)).view(np.int64).tolist()
                made["place"].append(p)
                mine = list(zip(words[p : p + WINDOW], own))
                made["words"].append(" ".join(w for w, k in mine if k == LITERAL))
                made["slots"].append([_MARKS[k] + w for w, k in mine if k != LITERAL])
        return made

    some = benchmark.select("item_id", text_key(benchmark).alias("text_key"), "text")
    return map_batches(some, f"item_id long, {_WINDOW_SCHEMA}", make)


def _hits(found: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bits are set in both bitmaps."""
    at = None
    for own, shift in zip(bits, _SHIFTS):
        some = found if at is None else found[at]
        bit = (some >> np.uint64(shift)) & np.uint64((1 << FILTER_BITS) - 1)
        hit = np.flatnonzero(own[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
        at = hit if at is None else at[hit]
    return at


def _document_windows(documents: DataFrame, bits: np.ndarray) -> DataFrame:
    """Windows of each document, by all layouts, whose bits are set. A slot may be any word:
    whether it is one is up to the item, so neither case nor the place in a sentence counts."""
    shared = documents.sparkSession.sparkContext.broadcast(bits)

    def make(batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {k: [] for k in ("doc_id", "text_key", "window", "place", "words", "slots")}
        ids, keys = (batch.column(c).to_pylist() for c in ("doc_id", "text_key"))

        def add(texts: np.ndarray, found: np.ndarray, places: np.ndarray) -> None:
            made["doc_id"] += [ids[i] for i in texts]
            made["text_key"] += [keys[i] for i in texts]
            made["window"] += found.view(np.int64).tolist()
            made["place"] += places.tolist()

        for joined, text, place, starts, ends, hashes, kinds in canonical(strings(batch, "text")):
            parted = _parted(code_points(joined), text, starts, ends)
            for size in range(1, min(WINDOW, len(hashes) + 1)):
                count = len(hashes) - size + 1
                at = np.flatnonzero(parted[:count] & parted[size:] & (text[:count] == text[size - 1 :]))
                runs = _short(np.stack([hashes[at + k] for k in range(size)]))
                hit = _hits(runs, shared.value)
                at = at[hit]
                add(text[at], runs[hit], place[at])
                for p in at.tolist():
                    made["words"].append(" ".join(_words(joined, starts[p : p + size], ends[p : p + size])))
                    made["slots"].append([])
            parts, seen = [hashes * f for f in _FACTORS], set()
            for layout in LAYOUTS:
                span = layout[-1][0] + layout[-1][1]
                count = len(hashes) - span + 1
                if count <= 0:
                    continue
                mixed = np.zeros(count, np.uint64)
                for k, (off, _, slot) in enumerate(layout):
                    mixed += _SLOTS[k] if slot else parts[k][off : off + count]
                mixed = _mixed(mixed)
                at = _hits(mixed, shared.value)
                at = at[text[at] == text[at + span - 1]]
                # Of layouts that find the same from one place on, the narrowest counts.
                new = [key not in seen for key in zip(at.tolist(), mixed[at].tolist())]
                at = at[np.array(new, bool)]
                seen.update(zip(at.tolist(), mixed[at].tolist()))
                add(text[at], mixed[at], place[at])
                for p in at.tolist():
                    words = _words(joined, starts[p : p + span], ends[p : p + span])
                    made["words"].append(" ".join(words[off] for off, _, slot in layout if not slot))
                    made["slots"].append([
                        _slot_mark(kinds[p + off : p + off + width]) + " ".join(words[off : off + width])
                        for off, width, slot in layout if slot
                    ])
        return made

    some = documents.select("doc_id", text_key(documents).alias("text_key"), "text")
    return map_batches(some, f"doc_id long, {_WINDOW_SCHEMA}", make)


def _slot_mark(kinds: np.ndarray) -> str:
    """Whether a slot's words are a number, words without one, or neither."""
    numbers = int((kinds == NUMBER).sum())
    return "w:" if not numbers else "n:" if len(kinds) == 1 else "x:"


def _filter_bits(items: DataFrame) -> np.ndarray:
    """Which values the first FILTER_BITS bits of the items' windows take, and the next, as two
    bitmaps: 2 MB each however large the benchmark is."""
    bits = np.zeros((len(_SHIFTS), 1 << (FILTER_BITS - 3)), np.uint8)
    for own, shift in zip(bits, _SHIFTS):
        part = F.shiftrightunsigned("window", shift).bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
        octets = (
            items.select(part.alias("bit")).distinct()
            .groupBy(F.shiftright("bit", 3).alias("at"))
            .agg(F.expr("bit_or(shiftleft(1, cast(bit & 7 as int)))").alias("octet"))
            .toArrow()
        )
        own[octets.column("at").to_numpy()] = octets.column("octet").to_numpy()
    return bits


def _slots_fit() -> Column:
    """A number stands for a number, other slots for words."""
    return F.forall(
        F.arrays_zip("item_slots", "slots"),
        lambda v: F.when(v["item_slots"].startswith("n:"), v["slots"].startswith("n:")).otherwise(
            v["slots"].startswith("w:")
        ),
    )


def _same_values() -> Column:
    return F.forall(
        F.arrays_zip("item_slots", "slots"),
        lambda v: F.substr(v["item_slots"], F.lit(3)) == F.substr(v["slots"], F.lit(3)),
    )


def _holds(words: Column, part: Column) -> Column:
    space = F.lit(" ")
    return F.contains(F.concat(space, words, space), F.concat(space, part, space))


def contaminated(documents: DataFrame, benchmark: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """(document, item) pairs that share at least `min_share` of the item's windows:
    doc_id, text_key, item_id, matched (windows), share, reparameterised (a value differs).

    A window is five words with at least three that are no slot. Of items without one all
    windows count, with their own values only; an item of fewer words is found between
    punctuation or the ends of lines. Windows with the item's own values always count, those with
    others on alignments on which each name of the item stands for one throughout; equal
    numbers may play several roles. Null and empty texts have no windows. Rows
    without doc_id or item_id take part under the null id; of items that share an id the
    windows count together. Repeated document rows give one result. Other columns are not
    read.
    """
    items = stage(_item_windows(benchmark), "items")
    totals = items.groupBy("item_id").agg(F.countDistinct("window").alias("total"))
    found = _document_windows(documents, _filter_bits(items))
    sides = items.select(
        "item_id", "window", "words", F.col("place").alias("item_place"), F.col("slots").alias("item_slots")
    )
    pairs = stage(
        found.join(sides, ["window", "words"]).where(_slots_fit()).select(
            "doc_id", "text_key", "item_id", "window",
            (F.col("place") - F.col("item_place")).alias("shift"),
            "item_slots", "slots", _same_values().alias("same"),
        ),
        "windows",
    )
    alignment = ["doc_id", "text_key", "item_id", "shift"]
    values = (
        pairs.where(F.size("slots") > 0)
        .select(*alignment, F.explode(F.arrays_zip("item_slots", "slots")).alias("v"))
        .select(
            *alignment, F.col("v.item_slots").alias("item_value"), F.substr("v.slots", F.lit(3)).alias("value")
        )
        .where(F.col("item_value").startswith("a:"))
        .groupBy(*alignment, "item_value")
        .agg(F.collect_set("value").alias("values"), F.max_by("value", F.length("value")).alias("longest"))
        # A window may end inside a name.
        .withColumn("one", F.forall("values", lambda v: _holds(F.col("longest"), v)))
        .groupBy(*alignment)
        .agg(F.bool_and("one").alias("consistent"))
    )
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"v.{c}")) for c in alignment]
    aligned = pairs.alias("p").join(values.alias("v"), same, "left").select(
        "p.doc_id", "p.text_key", "p.item_id", "window", "same",
        F.coalesce("consistent", F.lit(True)).alias("consistent"),
    )
    counted = (
        aligned.where(F.col("same") | F.col("consistent"))
        .groupBy("doc_id", "text_key", "item_id")
        .agg(
            F.countDistinct("window").alias("matched"),
            F.countDistinct(F.when(F.col("same"), F.col("window"))).alias("unchanged"),
        )
    )
    return (
        counted.alias("c")
        .join(totals.alias("t"), F.col("c.item_id").eqNullSafe(F.col("t.item_id")))
        .select(
            "doc_id", "text_key", "c.item_id", "matched",
            (F.col("matched") / F.col("total")).alias("share"),
            (F.col("unchanged") < F.col("matched")).alias("reparameterised"),
        )
        .where(F.col("share") >= min_share)
    )
