"""The rules once more in plain Python, one listing at a time."""

import re
import unicodedata
from collections import Counter


def standard(text):
    letters = []
    for char in unicodedata.normalize("NFD", text.lower()):
        if char.isascii() and (char.isalnum() or char.isspace()):
            letters.append(char)
    return " ".join("".join(letters).split())


def wage_and_text(text):
    words = text.split(" ")
    if len(words) >= 3 and all(w.isdigit() for w in words[:2]) and words[2][:1].isdigit():
        digits = re.match(r"\d+", words[2]).group()
        rest = " ".join([words[2][len(digits):], *words[3:]]).strip()
        return f"{int(words[1])}-{int(digits)}", rest
    if "a convenir" in text:
        pieces = text.split("a convenir")
        return "a convenir", "".join([p.rstrip() for p in pieces[:-1]] + pieces[-1:]).strip()
    return None, text


def features(text, words, pairs, low_order=False):
    known = [w for w in text.lower().split() if re.fullmatch("[a-zA-Z]+", w) and w in words]
    neighbours = [" ".join(p) for p in zip(known, known[1:])]
    kept_pairs = [p for p in neighbours if p in pairs]
    kept = [w for w, p in zip(known, neighbours) if p not in pairs] if low_order else known
    return known, kept_pairs, kept + kept_pairs


def lifts(texts, minimum):
    words, pairs = Counter(), Counter()
    for text in texts:
        parts = text.split()
        words.update(parts)
        pairs.update(zip(parts, parts[1:]))
    result = {}
    for (a, b), n in pairs.items():
        rare = words[a] < minimum or words[b] < minimum
        result[f"{a} {b}"] = -1.0 if rare else n / (words[a] * words[b] / len(texts))
    return result
