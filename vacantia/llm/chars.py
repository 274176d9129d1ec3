"""What code points are, as arrays that a text's characters index."""

from __future__ import annotations

import numpy as np

OTHER, LETTER, DIGIT, END = range(4)
CODE_POINTS = 0x30000  # from here on there are no letters of living scripts
LONG_WORD = 4096


# Scripts written without spaces: Thai, Lao, Myanmar, Khmer, kana, ideographs.
SPACELESS = (
    (0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3005, 0x3008), (0x3040, 0x3100),
    (0x31F0, 0x3200), (0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00), (0x20000, 0x30000),
)


class CharTables:
    """For each code point: its class, its lower case, whether it is upper case, whether its
    script has no spaces; and factors for hashing a word by the places of its characters."""

    def __init__(self) -> None:
        chars = [chr(c) for c in range(CODE_POINTS)]
        self.kinds = np.array([LETTER if c.isalpha() else OTHER for c in chars], np.uint8)
        self.kinds[ord("0") : ord("9") + 1] = DIGIT
        self.kinds[[ord(c) for c in ".!?\n"]] = END
        self.lower = np.array([ord(c.lower()[0]) for c in chars], np.uint32)
        self.upper = np.array([c.isupper() for c in chars], bool)
        self.spaceless = np.zeros(CODE_POINTS, bool)
        for first, last in SPACELESS:
            self.spaceless[first:last] = True
        powers = [1]
        for _ in range(LONG_WORD - 1):
            powers.append(powers[-1] * 0x9E3779B97F4A7C15 % (1 << 64))
        self.powers = np.array(powers, np.uint64)


def code_points(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.minimum(points, CODE_POINTS - 1)
