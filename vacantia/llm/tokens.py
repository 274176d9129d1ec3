"""Words and tokens of public vocabularies, remembered word by word."""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import sentencepiece
import tiktoken
from public_tokenizers import PATTERN
from tokenizers import Tokenizer

# Words that a worker remembers: token ids alone, and with the numbers of a WordTable.
REMEMBERED_WORDS = 800_000
TABLE_WORDS = 300_000
WORDS_AT_ONCE = 100_000

# --- fixed values: white space other than space and line feed is one of the first eight bytes
# in UTF-8, or begins with one of the last four ---
_ODD_BYTES = b"\x09\x0b\x0c\x0d\x1c\x1d\x1e\x1f" + b"\xc2\xe1\xe2\xe3"
# --- end of fixed values ---
# Beyond these code points, and around special tokens, the tokenizer file itself decides.
_PLAIN = re.compile(r"[\x09\x0a\x0d\x20-\x7e¡-ɏ]*")

_loaded: dict[tuple, object] = {}


def loaded(kind: Callable, *arguments: str) -> object:
    """One instance per worker process. A worker serves one stage after another, so what an
    earlier stage has loaded goes when another is asked for."""
    key = (kind.__module__, kind.__qualname__, *arguments)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = kind(*arguments)
    return _loaded[key]


def word_parts(text: str) -> list[str]:
    """Cut at single spaces between two visible characters, where no token reaches over, and
    take those spaces away. Other white space stays inside its part."""
    cut, octets = text.split(" "), text.encode()
    if (
        text[:1] in ("", " ", "\n")
        or text[-1] == " "
        or any(run in text for run in ("  ", " \n", "\n "))
        or len(octets.translate(None, _ODD_BYTES)) < len(octets)
    ):
        joined = [cut[0]]
        for part in cut[1:]:
            last = joined[-1]
            if part and last and not part[0].isspace() and not last[-1].isspace():
                joined.append(part)
            else:
                joined[-1] = f"{last} {part}"
        cut = joined
    return cut


class ByteLevelTokens:
    """Ids of a byte-level BPE file of the `tokenizers` library (no special tokens added).

    `path` is the .json file; a .tiktoken file of the same vocabulary beside it, if there,
    encodes plain words faster. Both give the same ids.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.fast = None
        try:
            with open(path.removesuffix(".json") + ".tiktoken", "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding(
                "vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
            )
        except FileNotFoundError:
            pass
        self.known = _Known(lambda part: array("I", self.ids(" " + part)).tobytes())

    def ids(self, part: str) -> list[int]:
        if self.fast is not None and "<|" not in part and _PLAIN.fullmatch(part):
            return self.fast.encode_ordinary(part)
        return self.tokenizer.encode(part, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.known) >= REMEMBERED_WORDS:
            self.known.clear()
        first, *others = word_parts(text)
        start = array("I", self.ids(first)).tobytes()
        return start + b"".join(map(self.known.__getitem__, others))


class _Known(dict):
    """Values worked out when they are first asked for."""

    def __init__(self, make: Callable):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class PieceTokens:
    """Pieces of a sentencepiece file with byte fallback."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.processor.get_piece_size()
        self.bytes = frozenset(i for i in range(size) if self.processor.is_byte(i))

    def counts(self, words: list[str]) -> list[tuple[int, int]]:
        """For each word by itself: its pieces, and those of them that are single bytes."""
        return [
            (len(pieces), len(pieces) - len([i for i in pieces if i not in self.bytes]))
            for pieces in self.processor.encode(words, num_threads=1)
        ]


class WordTable:
    """Numbers of words, worked out once per word and gathered for whole batches.

    `describe` gets new words and returns for each a tuple of numbers and a list of values.
    """

    def __init__(self, describe: Callable[[list], list[tuple[tuple, Sequence[int]]]], values: str):
        self.describe, self.type = describe, values
        self._clear()

    def _clear(self) -> None:
        self.new: list = []
        self.index = _Known(self._place)
        self.numbers: np.ndarray | None = None
        self.starts = np.zeros(1, np.int64)
        self.values = np.empty(0, self.type)

    def _place(self, word) -> int:
        self.new.append(word)
        return len(self.index)

    def of(self, words: list) -> np.ndarray:
        """The places of the words in `numbers` and `starts`, valid until the next call."""
        if len(self.index) >= TABLE_WORDS:
            self._clear()
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if self.new:
            described = self.describe(self.new)
            numbers = np.array([n for n, _ in described], np.int64)
            self.numbers = numbers if self.numbers is None else np.vstack([self.numbers, numbers])
            sizes = np.fromiter((len(v) for _, v in described), np.int64, len(self.new))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.values = np.concatenate(
                [self.values, np.array([x for _, v in described for x in v], self.type)]
            )
            self.new = []
        return at

    def spread(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in `values` of all values of the words in order, and each word's end among them."""
        sizes = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total), ends


def in_groups(
    texts: list[str], split: Callable[[str], list]
) -> Iterator[tuple[range, list, np.ndarray]]:
    """Words of several texts together, some texts at a time: the texts' places, their words,
    and where each text ends among them. Only so many words are held at once."""
    first, words, ends = 0, [], []
    for i, text in enumerate(texts):
        words += split(text)
        ends.append(len(words))
        if len(words) >= WORDS_AT_ONCE or i + 1 == len(texts):
            yield range(first, i + 1), words, np.array(ends)
            first, words, ends = i + 1, [], []
