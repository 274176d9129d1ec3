"""Encoding with a merge-type SentencePiece model by a table of prefixes, and decoding.

The encoding of a prefix of a text ends in exactly one token, so a table with the last token of
every prefix holds the whole encoding. An automaton gives the tokens that end at a place; the
one that may follow the last token of the prefix before it is the entry. Two tokens may stand
side by side if no merge, in the order of scores, ever reaches over their border. The ids are
read off the table from its end. The work is linear in the length of a text.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from vacantia.llm.common import map_batches, strings
from vacantia.llm.tokens import loaded

# --- fixed values: the model file's field numbers and the sign for a space ---
TRAINER, NORMALIZER = 2, 3
MODEL_TYPE, SPACE_AS_SUFFIX = 3, 24
RULES, DUMMY_PREFIX, EXTRA_SPACES, ESCAPE_SPACES, OWN_RULES = 2, 3, 4, 5, 6
BPE = 2
SPACE = "▁"
# --- end of fixed values ---
# What a worker remembers, and how many characters of a text may be one remembered word.
REMEMBERED_WORDS = 600_000
REMEMBERED_PAIRS = 2_000_000
WORD_LENGTH = 64

_NONE = 0  # the id for unknown, which no text has
_LAST = float("-inf")


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a serialized message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            octet = message[at]
            at += 1
            value |= (octet & 127) << shift
            shift += 7
            if octet < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


def _settings(processor: sentencepiece.SentencePieceProcessor) -> tuple[dict, dict]:
    parts = {f: v for f, v in _fields(processor.serialized_model_proto()) if f in (TRAINER, NORMALIZER)}
    return tuple(dict(_fields(parts.get(part, b""))) for part in (TRAINER, NORMALIZER))


class _Words(dict):
    """Ids of words, remembered unless the word is long."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self.make(word)
        if len(word) <= WORD_LENGTH:
            self[word] = ids
        return ids


class PrefixTable:
    """Encodes as `sentencepiece` does with this model, which must be of the merge type, take
    texts as they are but for spaces, and write unknown characters as bytes. Pieces that merging
    their own characters doesn't give are never tokens.
    """

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.processor
        trainer, normalizer = _settings(model)
        if trainer.get(MODEL_TYPE, 1) != BPE or trainer.get(SPACE_AS_SUFFIX):
            raise ValueError(f"{path} is no merge-type model with spaces before words")
        if (
            any(normalizer.get(rules) for rules in (RULES, OWN_RULES))
            or normalizer.get(EXTRA_SPACES, 1)
            or not normalizer.get(ESCAPE_SPACES, 1)
        ):
            raise ValueError(f"{path} rewrites texts before it encodes them")
        self.prefix = SPACE if normalizer.get(DUMMY_PREFIX, 1) else ""
        self.begin, self.end = model.bos_id(), model.eos_id()
        ids = range(model.get_piece_size())
        bytes_ = [i for i in ids if model.is_byte(i)]
        if len(bytes_) != 256 or any(map(model.is_unused, ids)) or model.unk_id() != _NONE:
            raise ValueError(f"{path} lacks bytes or the unknown piece, or has unused pieces")
        self.byte_ids = {int(model.id_to_piece(i)[3:-1], 16): i for i in bytes_}
        special = {*bytes_, *(i for i in ids if model.is_control(i) or model.is_unknown(i))}
        self.text_of = {i: model.id_to_piece(i) for i in ids if i not in special}
        self.scores = {text: model.get_score(i) for i, text in self.text_of.items()}
        self._build()
        self.words = _Words(self._ids)
        self.pairs: dict[int, bool] = {}

    def _build(self) -> None:
        """The automaton of all tokens, and what stands at each token's borders while it is merged."""
        # A character that only longer pieces hold is a symbol too, and is written as bytes.
        alone = {c for text in self.scores for c in text} - self.scores.keys()
        first_free = self.processor.get_piece_size()
        self.text_of |= dict(enumerate(sorted(alone), first_free))
        self.virtual = first_free
        self.size = first_free + len(alone)
        self.lengths = [len(self.text_of.get(token, "")) for token in range(self.size)]
        self.left: dict[int, list] = {}
        self.right: dict[int, list] = {}
        self.tokens = ahocorasick.Automaton()
        for token, text in self.text_of.items():
            left, right = self._borders(text)
            if left is not None:
                self.left[token], self.right[token] = left, right
                self.tokens.add_word(text, (token, len(text)))
        self.tokens.make_automaton()
        self.cuts = not any(SPACE in text.lstrip(SPACE) for text in self.scores)
        self.word = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def _borders(self, text: str) -> tuple[list | None, list | None]:
        """(score of the next merge, symbol at the border) from the characters to the whole, at
        the left and the right end; nothing if merging doesn't give the whole text."""
        symbols, left, right = list(text), [], []
        while len(symbols) > 1:
            found = [
                (self.scores[a + b], -i)
                for i, (a, b) in enumerate(zip(symbols, symbols[1:]))
                if a + b in self.scores
            ]
            if not found:
                return None, None
            score, at = max(found)
            left.append((score, symbols[0]))
            right.append((score, symbols[-1]))
            symbols[-at : 2 - at] = [symbols[-at] + symbols[1 - at]]
        return [*left, (_LAST, text)], [*right, (_LAST, text)]

    def _may_meet(self, a: int, b: int) -> bool:
        """Whether both tokens stay as they are side by side. Their merges are gone through in
        the order of scores, of equal ones the leftmost first; one over the border ends it."""
        before, after = iter(self.right[a]), iter(self.left[b])
        score_a, symbol_a = next(before)
        score_b, symbol_b = next(after)
        while True:
            over = self.scores.get(symbol_a + symbol_b)
            if over is not None and over > score_a and over >= score_b:
                return False
            if score_a == score_b == _LAST:
                return True
            if score_a >= score_b:
                score_a, symbol_a = next(before)
            else:
                score_b, symbol_b = next(after)

    def last_tokens(self, text: str) -> list[int]:
        """For each place, the last token of the prefix that ends there. 0 stands for none: at a
        character that no token holds, which nothing reaches over, and in one more entry at the
        end, which is the place before the first."""
        last = [_NONE] * (len(text) + 1)
        pairs, size = self.pairs, self.size
        if len(pairs) >= REMEMBERED_PAIRS:
            pairs.clear()
        for place, (token, length) in self.tokens.iter(text):
            if last[place]:
                continue
            before = last[place - length]
            if before:
                key = before * size + token
                try:
                    fits = pairs[key]
                except KeyError:
                    fits = pairs[key] = self._may_meet(before, token)
                if not fits:
                    continue
            last[place] = token
        return last

    def _ids(self, text: str) -> bytes:
        """Ids of a text with spaces already replaced, as little-endian unsigned integers."""
        last, lengths, virtual = self.last_tokens(text), self.lengths, self.virtual
        ids, place = [], len(text) - 1
        while place >= 0:
            token = last[place]
            if token == _NONE or token >= virtual:
                ids.extend(self.byte_ids[octet] for octet in reversed(text[place].encode()))
                place -= 1
            else:
                ids.append(token)
                place -= lengths[token]
        ids.reverse()
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids, without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        text = self.prefix + text.replace(" ", SPACE)
        if not self.cuts:
            return self._ids(text)
        # No piece has a space after another character, so no token reaches over such a place.
        if len(self.words) >= REMEMBERED_WORDS:
            self.words.clear()
        return b"".join(map(self.words.__getitem__, self.word.findall(text)))

    def wrapped(self, text: str) -> bytes:
        """The ids with those for begin and end."""
        around = [array("I", [i] if i >= 0 else []).tobytes() for i in (self.begin, self.end)]
        return self.encode(text).join(around)

    def decode(self, ids: Iterable[int]) -> str:
        return self.processor.decode(list(ids))


def encode(documents: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers, begin and end included) and decoded,
    the text that these ids give back, one row per row of `documents`.

    Null and empty texts are begin and end alone, and decode to an empty text. Repeated rows and
    rows without doc_id are kept as they come. Other columns are not read. Nothing is shuffled.
    """

    def make(batch: pa.RecordBatch) -> dict:
        table = loaded(PrefixTable, model_path)
        ids = [table.wrapped(text) for text in strings(batch, "text")]
        return {
            "doc_id": batch.column("doc_id"),
            "ids": ids,
            "decoded": [table.decode(memoryview(one).cast("I").tolist()) for one in ids],
        }

    return map_batches(
        documents.select("doc_id", "text"), "doc_id long, ids binary, decoded string", make
    )
