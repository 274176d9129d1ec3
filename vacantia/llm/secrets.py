"""Secrets by patterns, and by a character network over every other candidate.

Candidates are all runs of twelve key characters or more, with digits or without, that no base
match holds whole. The network reads a candidate and its surroundings as characters: one
convolution, the strongest answer of each filter, one output. It is trained here on labelled
findings: base matches, also with their bytes written in other alphabets, against words, long
runs of letters, and words and numbers of the texts in the shapes that dates, identifiers, paths
and the like have. It is calibrated on findings held out, and its threshold is the highest that
keeps the recall asked for.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacantia.llm.common import map_batches, strings
from vacantia.llm.spans import Covered, Span, sha256, written
from vacantia.operators.ranking import add_position
from vacantia.scratch import stage

# --- fixed values: kinds and patterns ---
KINDS = ("assign", "access", "hex", "network")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.ASCII | re.IGNORECASE,
)
MIN_ASSIGNED = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
MIN_ACCESS = 18
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}+")
# --- end of fixed values ---

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+")
# What keys are written in: base 64 and its web form, base 62, letters, base 32, base 36
# and base 16 in capitals.
_UPPER, _LOWER, _DIGITS = string.ascii_uppercase, string.ascii_lowercase, string.digits
ALPHABETS = (
    _UPPER + _LOWER + _DIGITS + "+/", _UPPER + _LOWER + _DIGITS + "-_",
    _UPPER + _LOWER + _DIGITS, _UPPER + _LOWER, _UPPER + "234567", _LOWER + _DIGITS, "ABCDEF" + _DIGITS,
)
# Harmless shapes: d and D a digit (D not zero), 0 zeros, x and X a hexadecimal digit, w, W and C
# a word of the text in lower case, upper case or with a capital, u two to five capitals.
SHAPES = (
    "20dd-0D-1dT1d", "20dd-0D-2dT0d-2d", "20dd0D2dT1d3d4dZ", "20dd/1d/1d-1d", "1d-0D-20dd-1d",
    "Ddddddddddddd", "Dddddddddddd", "D00000000000", "D000000000000", "16dddddddd", "17ddddddddddd",
    "978-D-dd-dddddd-d", "979-dd-ddd-dddd-d", "978dddddddddd", "0Ddd-dddd-dddd", "+Dd-Ddd-ddddddd",
    "+DdDddddddddd", "00Dd-Ddd-ddddddd", "u-20dd-00dddd", "u-dddddddd", "u-Ddd-dddddd", "u20dd00dddd",
    "u-D-dddddddd", "W-ddddddd", "W_Dddddd", "u/20dd/0dddd", "W-20dd-ddddd", "wDddddddddd",
    "xxxxxxxx-xxxx-4xxx-axxx-xxxxxxxxxxxx", "xxxxxxxx-xxxx-1xxx-8xxx-xxxxxxxxxxxx",
    "XXXXXXXX-XXXX-4XXX-BXXX-XXXXXXXXXXXX",
    "xxxxxxxx-xxxx-xxxx-xxxx-xxxxxxxxxxxx", "w-xxxxxxxx-xxxx-4xxx-9xxx-xxxxxxxxxxxx", "w-w-w", "w_w_w", "w-w-20dd", "w_w_Dd", "wCC", "CCC",
    "wC", "CC", "w/w/w", "/w/w/w", "w/w/20dd/0D", "w/w-w/Dd", "W_W_W", "W_W", "w-w-w-w", "C-C-C", "w=w/w",
    "vD-d-d-w", "w-D-d-dd-w", "www-w-w", "--------------", "============", "____________", "w+w+w",
)
ORDINARY = re.compile(r"[^\W\d_]{6,}")
CONTEXT = 12
TILE = 48
KERNEL = 5
FILTERS = 24
PRINTABLE = 96  # printable ASCII, and one place for all else
SYMBOLS = 2 * PRINTABLE  # inside the candidate and around it
# With more findings of a label than this, the network starts from those with the smallest hash
# and is then trained on all, in parts of about PART, and calibrated on all that are held out. The
# two labels weigh as much against each other as these numbers.
START = {"secret": 2500, "word": 6000}
PART = 50_000
ROUNDS = 2
ROUND_RATE = 0.002
SUMS = 8
WORDS_PER_TEXT = 2
SHAPES_PER_TEXT = 4
# Keys written anew in other alphabets, per secret; more where secrets are few, up to so many.
REWRITTEN, REWRITTEN_IN_ALL = 3, 900
MOST_TILES = 16  # of a finding that trains the network
EPOCHS = 12
BATCH = 64
MIN_STEPS = 400
RATE = 0.01
MIN_RECALL = 0.98
MIN_PROBABILITY = 0.5


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind; too short ones are dropped."""
    spans: list[Span] = [
        ("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGNED
    ]
    if "AKIA" in text:
        spans += [
            ("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= MIN_ACCESS
        ]
    return spans + [("hex", *m.span()) for m in HEX.finditer(text)]


def _characters(text: str, shift: int = 0) -> bytes:
    return bytes(shift + (ord(c) - 32 if " " <= c < "\x7f" else PRINTABLE - 1) for c in text)


def surroundings(text: str, start: int, end: int) -> bytes:
    """The candidate and CONTEXT characters on each side, as symbols; a character has another
    symbol outside the candidate, so that a neighbour's key doesn't count as its own."""
    before = text[max(0, start - CONTEXT) : start].rjust(CONTEXT)
    after = text[end : end + CONTEXT].ljust(CONTEXT)
    return (
        _characters(before, PRINTABLE)
        + _characters(text[start:end])
        + _characters(after, PRINTABLE)
    )


def labelled(text: str, spans: list[Span]) -> list[tuple[str, int, int]]:
    """Findings with their label: base matches, ordinary words, and what is to be scored. Of an
    assignment the value is the finding; the keyword belongs to its surroundings."""
    found = [
        ("secret", *(ASSIGN.match(text, start).span(2) if kind == "assign" else (start, end)))
        for kind, start, end in spans
    ]
    inside = _Inside(spans)
    runs = [m.span() for m in CANDIDATE.finditer(text) if not inside.holds(*m.span())]
    found += [("open", *span) for span in runs]
    words = [span for span in runs[:WORDS_PER_TEXT] if _plain_letters(text[slice(*span)])]
    for k in range(WORDS_PER_TEXT):
        # Spread over the text, each from the next space on.
        m = ORDINARY.search(text, max(0, text.find(" ", len(text) * k // WORDS_PER_TEXT)))
        if m and m.span() not in words:
            words.append(m.span())
    # Letters that are part of a match or of a longer run are no word.
    covered = Covered([f for f in found if (f[1], f[2]) not in words])
    return found + [("word", *span) for span in sorted(words) if not covered.meets(*span)]


def _plain_letters(run: str) -> bool:
    """A long word: letters in lower case, in capitals, or with one capital first."""
    return run.isalpha() and (run[1:].islower() or run.isupper())


class _Inside:
    """Whether one of some spans holds a stretch of text whole; asked from left to right."""

    def __init__(self, spans: list[Span]):
        self.spans = sorted((start, end) for _, start, end in spans)
        self.at, self.reach = 0, 0

    def holds(self, start: int, end: int) -> bool:
        while self.at < len(self.spans) and self.spans[self.at][0] <= start:
            self.reach = max(self.reach, self.spans[self.at][1])
            self.at += 1
        return self.reach >= end


def shaped(words: list[str], shape: str, draw: random.Random) -> str:
    """A harmless run: the shape, filled with words and random digits."""
    made = []
    for sign in shape:
        if sign == "d":
            made.append(draw.choice(_DIGITS))
        elif sign == "D":
            made.append(draw.choice(_DIGITS[1:]))
        elif sign in "xX":
            digit = draw.choice("0123456789abcdef")
            made.append(digit if sign == "x" else digit.upper())
        elif sign == "u":
            made.append("".join(draw.choices(_UPPER, k=draw.randrange(2, 6))))
        elif sign in "wWC":
            word = draw.choice(words)
            made.append({"w": word, "W": word.upper(), "C": word.capitalize()}[sign])
        else:
            made.append(sign)
    return "".join(made)


def shaped_findings(text: str, count: int = SHAPES_PER_TEXT) -> list[bytes]:
    """Harmless runs of shapes drawn by a hash of the text, where words of it stand."""
    places = [m.span() for m in islice(ORDINARY.finditer(text), 40)]
    words = [text[a:b].lower() for a, b in places if text[a:b].isascii()]
    if not words:
        return []
    draw = random.Random(xxhash.xxh64_intdigest(text))
    found = []
    for _ in range(count):
        start, end = draw.choice(places)
        run = shaped(words, draw.choice(SHAPES), draw)
        found.append(
            _characters(text[max(0, start - CONTEXT) : start].rjust(CONTEXT), PRINTABLE)
            + _characters(run)
            + _characters(text[end : end + CONTEXT].ljust(CONTEXT), PRINTABLE)
        )
    return found


def rewritten(value: bytes, count: int = REWRITTEN) -> list[bytes]:
    """Keys in other alphabets that follow from the bytes of a secret, as symbols."""
    draw = random.Random(xxhash.xxh64_intdigest(value))
    first = draw.randrange(len(ALPHABETS))
    return [
        _characters("".join(draw.choices(ALPHABETS[(first + k) % len(ALPHABETS)], k=draw.randrange(16, 45))))
        for k in range(count)
    ]


_FINDING = "struct<label:string,start:int,end:int,symbols:binary>"


def find(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, base counts and spans, and `findings` with their surroundings."""

    def make(batch: pa.RecordBatch) -> dict:
        made: dict[str, list] = {
            k: [] for k in ("n_assign", "n_access", "n_hex", "base", "findings")
        }
        for text in strings(batch, "text"):
            spans = base_spans(text)
            for kind in KINDS[:3]:
                made[f"n_{kind}"].append(sum(span[0] == kind for span in spans))
            made["base"].append(written(spans, KINDS))
            made["findings"].append([
                {"label": label, "start": a, "end": b, "symbols": surroundings(text, a, b)}
                for label, a, b in labelled(text, spans)
            ] + [
                {"label": "word", "start": 0, "end": 0, "symbols": symbols}
                for symbols in shaped_findings(text)
            ])
        return made | {"doc_id": batch.column("doc_id")}

    schema = (
        "doc_id long, n_assign long, n_access long, n_hex long, base string, "
        f"findings array<{_FINDING}>"
    )
    return map_batches(documents.select("doc_id", "text"), schema, make)


def tiles(symbols: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of TILE symbols; a long finding has several that overlap by a kernel. Also where
    each finding's rows begin."""
    rows, firsts = [], []
    for own in symbols:
        firsts.append(len(rows))
        for at in range(0, max(1, len(own) - KERNEL + 1), TILE - KERNEL + 1):
            rows.append(own[at : at + TILE].ljust(TILE, b"\0"))
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, TILE), np.array(firsts)


PARAMETERS = ("kernel", "bias", "out", "shift")


class Network:
    """A convolution over symbols, given as a table per place of the kernel, then the largest
    answer of each filter, then a calibrated logistic output."""

    def __init__(self, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.kernel = draw.normal(0, 0.1, (KERNEL, SYMBOLS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = draw.normal(0, 0.3, FILTERS).astype(np.float32)
        self.shift = np.zeros(1, np.float32)
        self.scale, self.offset, self.threshold = 1.0, 0.0, 1.0

    def answers(self, rows: np.ndarray) -> np.ndarray:
        places = TILE - KERNEL + 1
        total = self.kernel[0][rows[:, :places]]
        for k in range(1, KERNEL):
            total = total + self.kernel[k][rows[:, k : k + places]]
        return total + self.bias

    def scores(self, symbols: list[bytes], at_once: int = 2048) -> np.ndarray:
        """Uncalibrated scores of findings."""
        made = []
        for first in range(0, len(symbols), at_once):
            rows, firsts = tiles(symbols[first : first + at_once])
            best = np.concatenate([
                self.answers(rows[a : a + at_once]).max(axis=1)
                for a in range(0, len(rows), at_once)
            ])
            strongest = np.maximum(np.maximum.reduceat(best, firsts), 0)
            made.append(strongest @ self.out + self.shift)
        return np.concatenate(made) if made else np.empty(0, np.float32)

    def probabilities(self, symbols: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.scores(symbols) + self.offset, -30, 30)))

    def train(
        self, symbols: list[bytes], labels: np.ndarray, seed: int = 11,
        weights: np.ndarray | None = None, epochs: int | None = None, rate: float = RATE,
    ) -> None:
        """Adam on the logistic loss, over all tiles of a finding, MOST_TILES at most."""
        longest = MOST_TILES * (TILE - KERNEL + 1)
        rows, firsts = tiles([own[:longest] for own in symbols])
        ends = np.append(firsts[1:], len(rows))
        draw = np.random.default_rng(seed)
        state = {n: (np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))) for n in PARAMETERS}
        step = 0
        for _ in range(epochs or max(EPOCHS, -(-MIN_STEPS * BATCH // len(firsts)))):
            order = draw.permutation(len(firsts))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                sizes = ends[some] - firsts[some]
                own = np.concatenate([np.arange(firsts[i], ends[i]) for i in some])
                own_weights = None if weights is None else weights[some]
                grads = self._gradients(rows[own], labels[some], np.cumsum(sizes) - sizes, own_weights)
                step += 1
                for name, grad in grads.items():
                    mean, square = state[name]
                    mean += 0.1 * (grad - mean)
                    square += 0.001 * (grad * grad - square)
                    by = rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    setattr(self, name, getattr(self, name) - by * mean / (np.sqrt(square) + 1e-8))

    def _gradients(
        self, rows: np.ndarray, labels: np.ndarray, firsts: np.ndarray | None = None,
        weights: np.ndarray | None = None,
    ) -> dict[str, np.ndarray]:
        """Of the mean loss of findings whose rows begin at `firsts`; a row each without it."""
        firsts = np.arange(len(rows)) if firsts is None else firsts
        answers = self.answers(rows)
        place = answers.argmax(axis=1)
        best = np.take_along_axis(answers, place[:, None, :], axis=1)[:, 0, :]
        # The row of each finding that answers each filter most strongly.
        top = np.maximum.reduceat(best, firsts)
        finding = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(rows))))
        wins = best == top[finding]
        row = np.full(top.shape, len(rows))
        at, which = np.nonzero(wins)
        np.minimum.at(row, (finding[at], which), at)
        filters = np.broadcast_to(np.arange(FILTERS), row.shape)
        place = place[row, filters]
        strong = np.maximum(top, 0)
        error = (1 / (1 + np.exp(-(strong @ self.out + self.shift))) - labels) / len(firsts)
        error = error if weights is None else error * weights
        back = (error[:, None] * self.out) * (top > 0)
        kernel = np.zeros_like(self.kernel)
        for k in range(KERNEL):
            np.add.at(kernel[k], (rows[row, place + k], filters), back)
        return {
            "kernel": kernel + 1e-5 * self.kernel, "bias": back.sum(axis=0),
            "out": strong.T @ error, "shift": np.array([error.sum()]),
        }

    def to_vector(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in PARAMETERS]).astype(float)

    def from_vector(self, vector: np.ndarray) -> Network:
        made, at = Network(), 0
        for name in PARAMETERS:
            like = getattr(made, name)
            setattr(made, name, vector[at : at + like.size].reshape(like.shape).astype(np.float32))
            at += like.size
        return made

    def calibrate(self, symbols: list[bytes], labels: np.ndarray) -> None:
        """Fit probability to score on held-out findings, then set the threshold."""
        score = self.scores(symbols).astype(float)
        spread = score.std() or 1.0
        design = np.column_stack([score / spread, np.ones_like(score)])
        weights = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
            hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
            weights -= np.linalg.solve(hessian, design.T @ (p - labels) + 1e-3 * weights)
        self.scale, self.offset = float(weights[0] / spread), float(weights[1])
        secret = np.sort(self.probabilities(symbols)[labels > 0])
        keep = secret[int(np.floor((1 - MIN_RECALL) * len(secret)))] if len(secret) else 1.0
        self.threshold = max(MIN_PROBABILITY, float(keep))


def _digits_alone(symbols: bytes) -> bool:
    return all(16 <= c < 26 for c in symbols)


def _is_held_out(symbols: bytes) -> bool:
    return xxhash.xxh64_intdigest(symbols) % 4 == 0


def _shown(label: str, findings: list[bytes], words: list[bytes], anew: int) -> tuple[list, list]:
    """(symbols, value) as the network is shown findings: those to train on and those held out.
    Each is also shown without its surroundings, and a secret in those of a word and in `anew`
    other alphabets, so that neither the network nor the threshold rests on the words before it
    or on one kind of key."""
    train: list[tuple[bytes, float]] = []
    held: list[tuple[bytes, float]] = []
    value = float(label == "secret")
    for i, symbols in enumerate(findings):
        side = held if _is_held_out(symbols) else train
        bare = symbols[CONTEXT:-CONTEXT]
        side += [(symbols, value), (bare, value)]
        if value:
            keys = rewritten(bare, anew)
            if words:
                word = words[i % len(words)]
                side.append((word[:CONTEXT] + bare + word[-CONTEXT:], value))
            side += [(symbols[:CONTEXT] + key + symbols[-CONTEXT:], value) for key in keys[::3]]
            for k, key in enumerate(keys if words else ()):
                word = words[(i * anew + k) % len(words)]
                side.append((word[:CONTEXT] + key + word[-CONTEXT:], value))
    return train, held


def _parted(labelled: DataFrame, parts: int) -> DataFrame:
    """Dealt out and ordered by hash, so that a part is the same however the table is laid out."""
    return labelled.repartition(parts, "h").sortWithinPartitions("h", "symbols").select("label", "symbols")


def _shown_part(batches: Iterator[pa.RecordBatch], anew: int) -> tuple[list, list]:
    """What is shown of a part; secrets appear among the words of the part."""
    found: dict[str, list[bytes]] = {label: [] for label in START}
    for batch in batches:
        for label, symbols in zip(batch["label"].to_pylist(), batch["symbols"].to_pylist()):
            found[label].append(symbols)
    # Digits alone may be a secret to a pattern, but teach that numbers are secrets.
    secrets = [own for own in found["secret"] if not _digits_alone(own[CONTEXT:-CONTEXT])]
    sides = (_shown("secret", secrets, found["word"], anew), _shown("word", found["word"], [], anew))
    return sides[0][0] + sides[1][0], sides[0][1] + sides[1][1]


def _train_round(
    labelled: DataFrame, parts: int, network: Network, anew: int, weights: dict[float, float]
) -> Network:
    """Each part trains the network on all of its findings once; the mean of the results, weighted
    by how much was shown."""
    shared = labelled.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, _ = _shown_part(batches, anew)
        if train:
            local = shared.value.from_vector(shared.value.to_vector())
            values = np.array([value for _, value in train], np.float32)
            own = np.where(values > 0, weights[1.0], weights[0.0]).astype(np.float32)
            local.train([symbols for symbols, _ in train], values, weights=own, epochs=1, rate=ROUND_RATE)
            vector = np.append(local.to_vector(), 1.0) * len(train)
            yield pa.RecordBatch.from_pydict({"vector": [vector.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for vector in batch["vector"].to_pylist():
                values = np.frombuffer(vector)
                total = values if total is None else total + values
        if total is not None:
            yield pa.RecordBatch.from_pydict({"vector": [total.tobytes()]})

    trained = _parted(labelled, parts).mapInArrow(work, "vector binary")
    sums = trained.repartition(SUMS).mapInArrow(add, "vector binary").collect()
    total = sum(np.frombuffer(bytes(row["vector"])) for row in sums)
    return network.from_vector(total[:-1] / total[-1])


def _calibrate_on_all(
    labelled: DataFrame, parts: int, network: Network, anew: int, weights: dict[float, float]
) -> None:
    """`calibrate` over all held-out findings: they are scored once, the fit takes sums over the
    scores, and the threshold is the value at its exact place among the secrets."""
    shared = labelled.sparkSession.sparkContext.broadcast(network)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, held = _shown_part(batches, anew)
        if held:
            made = shared.value.scores([symbols for symbols, _ in held]).astype(float)
            yield pa.RecordBatch.from_arrays(
                [pa.array(made), pa.array([value for _, value in held])], names=["score", "value"]
            )

    scored = stage(_parted(labelled, parts).mapInArrow(score, "score double, value double"), "scores")
    spread = scored.agg(F.stddev_pop("score")).first()[0] or 1.0
    x, w = F.col("score") / spread, F.when(F.col("value") > 0, weights[1.0]).otherwise(weights[0.0])
    fitted = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + F.exp(-F.greatest(F.least(x * float(fitted[0]) + float(fitted[1]), F.lit(30.0)), F.lit(-30.0))))
        bend, miss = w * p * (1 - p), w * (p - F.col("value"))
        sums = [bend * x * x, bend * x, bend, miss * x, miss]
        a, b, c, d, e = scored.agg(*[F.sum(each) for each in sums]).first()
        step = np.linalg.solve(
            np.array([[a, b], [b, c]]) + 1e-3 * np.eye(2), np.array([d, e]) + 1e-3 * fitted
        )
        fitted -= step
        if np.abs(step).max() < 1e-9:
            break
    network.scale, network.offset = float(fitted[0] / spread), float(fitted[1])
    keys = stage(scored.where("value > 0").select((F.col("score") * network.scale).alias("s")), "keys")
    place = int(np.floor((1 - MIN_RECALL) * keys.count())) + 1
    row = add_position(keys, "place", F.col("s")).where(F.col("place") == place).first()
    keep = 1.0 if row is None else 1 / (1 + np.exp(-np.clip(row["s"] + network.offset, -30, 30)))
    network.threshold = max(MIN_PROBABILITY, float(keep))


def fit(findings: DataFrame) -> Network | None:
    """Train on all different findings (label, symbols), secrets and words; a quarter, by a hash,
    is held out to calibrate. Up to START of a label they are trained on here; with more, those
    START with the smallest hash only give the first weights, and Spark trains and calibrates on
    all. None if there are too few of either label."""
    labelled = stage(
        findings.where(F.col("label").isin(*START))
        .select("label", "symbols", F.xxhash64("symbols").alias("h"))
        .distinct(),
        "labelled",
    )
    counts = {row["label"]: row["count"] for row in labelled.groupBy("label").count().collect()}
    first: dict[str, list[bytes]] = {}
    for label in START:
        rows = labelled.where(F.col("label") == label).orderBy("h", "symbols").limit(START[label])
        first[label] = [bytes(row["symbols"]) for row in rows.collect()]
    # Digits alone may be a secret to a pattern, but teach that numbers are secrets.
    first["secret"] = [own for own in first["secret"] if not _digits_alone(own[CONTEXT:-CONTEXT])]
    if min(map(len, first.values())) < 8:
        return None
    anew = max(REWRITTEN, -(-REWRITTEN_IN_ALL // max(1, len(first["secret"]))))
    sides = [_shown(label, first[label], first["word"], anew) for label in START]
    train, held = (sides[0][k] + sides[1][k] for k in (0, 1))
    network = Network()
    network.train([s for s, _ in train], np.array([v for _, v in train], np.float32))
    if all(counts[label] <= START[label] for label in START):
        held = held if {v for _, v in held} == {0.0, 1.0} else train
        network.calibrate([s for s, _ in held], np.array([v for _, v in held]))
        return network
    parts = -(-sum(counts.values()) // PART)
    # A label of which there is more than START weighs no more than START of it.
    shares = {label: min(1.0, START[label] / counts[label]) for label in START}
    most = max(shares.values())
    weights = {1.0: shares["secret"] / most, 0.0: shares["word"] / most}
    for _ in range(ROUNDS):
        network = _train_round(labelled, parts, network, anew, weights)
    _calibrate_on_all(labelled, parts, network, anew, weights)
    return network


def scan(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex and base_sha256 of the base matches, and
    spans: base matches and the candidates the network takes for secrets (kind `network`).

    Null and empty texts have no spans. Rows without doc_id are searched like others,
    repeated rows each. Without enough labelled findings there is no network and nothing is
    added. Other columns are not read.
    """
    found = stage(find(documents), "secrets")
    network = fit(found.select(F.explode("findings").alias("f")).select("f.label", "f.symbols"))
    shared = found.sparkSession.sparkContext.broadcast(network)
    opened = F.filter("findings", lambda f: f["label"] == "open").alias("opened")
    rows = found.select("doc_id", "n_assign", "n_access", "n_hex", "base", opened)

    def make(batch: pa.RecordBatch) -> dict:
        bases, opened = batch.column("base").to_pylist(), batch.column("opened").to_pylist()
        every = [finding for own in opened for finding in own]
        model = shared.value
        taken = np.zeros(len(every), bool)
        if model is not None and every:
            taken = model.probabilities([f["symbols"] for f in every]) >= model.threshold
        spans, at = [], 0
        for base, own in zip(bases, opened):
            kept = [s.split(":") for s in base.split(",") if s]
            kept = [(kind, int(a), int(b)) for kind, a, b in kept]
            for finding in own:
                if taken[at]:
                    kept.append(("network", finding["start"], finding["end"]))
                at += 1
            spans.append(written(kept, KINDS))
        names = ("doc_id", "n_assign", "n_access", "n_hex")
        return {name: batch.column(name) for name in names} | {
            "base_sha256": map(sha256, bases), "spans": spans,
        }

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return map_batches(rows, schema, make)
