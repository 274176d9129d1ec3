import itertools
import random
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vacantia.llm import packing
from vacantia.llm.tokens import ByteLevelTokens

from .conftest import EDGE_ROWS


@pytest.fixture(scope="module")
def tokens(vocabularies):
    return ByteLevelTokens(vocabularies[0]), Tokenizer.from_file(vocabularies[0])


def same(tokens, text):
    ours, library = tokens
    expected = library.encode(text, add_special_tokens=False).ids
    return ours.encode(text) == struct.pack(f"<{len(expected)}I", *expected)


ODD = ["", " ", "  ", "a", "ab", "Don't", "\n", "\t", " \n", "<|endoftext|>", "12", "é", "漢", "\x1c", "\xa0",
       " ", "ß,", "\U0001f600", "'s", "...", "\r\n", "ﬁ", "²", "<|"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=12), st.sampled_from(["", " "]))
def test_ids_are_the_tokenizer_files(tokens, parts, between):
    assert same(tokens, between.join(parts))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_ids_of_any_text(tokens, text):
    assert same(tokens, text)


def test_ids_of_the_given_texts(spark, tokens):
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert same(tokens, row["text"])


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 20))
def test_fill_is_the_best_of_all(counts, room):
    chosen = packing.best_fill(counts, room)
    assert all(chosen[length] <= counts[length] for length in chosen)
    choices = itertools.product(*[range(c + 1) for c in counts.values()])
    sums = [sum(n * length for n, length in zip(choice, counts)) for choice in choices]
    assert sum(length * n for length, n in chosen.items()) == max(s for s in sums if s <= room)


def test_plan_spends_every_count_and_wastes_little():
    draw = random.Random(1)
    counts = {length: draw.randint(1, 400_000 // length) for length in range(1, 1025)}
    patterns = packing.plan(counts)
    spent = {}
    for pattern, times in patterns:
        assert sum(length * n for length, n in pattern.items()) <= 1024
        for length, n in pattern.items():
            spent[length] = spent.get(length, 0) + n * times
    assert spent == counts
    tokens = sum(length * count for length, count in counts.items())
    assert sum(times for _, times in patterns) <= tokens / 1024 * 1.005 + 1


def check(rows, documents, library, capacity=1024):
    """Each id in one piece, pieces' sums right, sequences gapless."""
    texts = sorted(documents, key=lambda d: (d[0] is None, d[0], d[1] or ""))
    ids = [library.encode(t or "", add_special_tokens=False).ids + [0] for _, t, *_ in texts]
    expected = []
    for (doc_id, *_), own in zip(texts, ids):
        for start in range(0, len(own), capacity):
            part = own[start : start + capacity]
            expected.append((doc_id, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)), len(own)))
    got = [tuple(r[c] for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return sequences


def test_given_table(spark, tokens, vocabularies):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.pack(table, vocabularies[0]).collect()
    documents = [(r["doc_id"], r["text"]) for r in table.collect()]
    sequences = check(rows, documents, tokens[1])
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= total / 1024 * 1.03 + 1


def test_edges(make_documents, tokens, vocabularies):
    rows = packing.pack(make_documents(EDGE_ROWS), vocabularies[0]).collect()
    check(rows, EDGE_ROWS, tokens[1])
    assert packing.pack(make_documents([]), vocabularies[0]).collect() == []


def test_one_length_for_all(make_documents, tokens, vocabularies):
    documents = [(i, "same text here") for i in range(3000)]
    rows = packing.pack(make_documents(documents), vocabularies[0]).collect()
    sequences = check(rows, documents, tokens[1])
    length = rows[0]["length"]
    assert len(sequences) == -(-3000 // (1024 // length))
