"""Spans of kinds in a text, written as one line and hashed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

Span = tuple[str, int, int]


def written(spans: Iterable[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    order = {kind: i for i, kind in enumerate(kinds)}
    ordered = sorted(set(spans), key=lambda s: (s[1], order[s[0]], s[2]))
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in ordered)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Covered:
    """Whether a stretch of text meets any of some spans; asked from left to right."""

    def __init__(self, spans: Iterable[Span]):
        self.spans = sorted((start, end) for _, start, end in spans)
        self.at, self.reach = 0, 0

    def meets(self, start: int, end: int) -> bool:
        while self.at < len(self.spans) and self.spans[self.at][0] < end:
            self.reach = max(self.reach, self.spans[self.at][1])
            self.at += 1
        return self.reach > start
