import random
import time

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import EDGE_ROWS
from vacantia.llm import prefixtable
from vacantia.llm.common import table
from vacantia.llm.prefixtable import PrefixTable
from vacantia.llm.queries import piece_vocabulary


@pytest.fixture(scope="module")
def prefixes():
    return PrefixTable(piece_vocabulary())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_vocabulary())


def ids_of(octets):
    return memoryview(octets).cast("I").tolist()


def same(prefixes, library, text):
    return ids_of(prefixes.wrapped(text)) == library.encode(text, add_bos=True, add_eos=True)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(prefixes, library, text):
    assert same(prefixes, library, text)


@given(st.text(alphabet=" ▁-=*/\nae<0x>\t", max_size=90))
@settings(max_examples=300, deadline=None)
def test_runs_of_pieces_with_equal_scores(prefixes, library, text):
    assert same(prefixes, library, text)


def test_pieces_strung_together(prefixes, library):
    rng = random.Random(5)
    pieces = [library.id_to_piece(i) for i in range(len(library))]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randrange(1, 7)))
        assert same(prefixes, library, text), text


def test_whole_text_without_cuts_at_spaces(prefixes, library):
    text = table_text = "the cat  sat on\nthe mat, 12 times - ünder 漢字 " * 20
    prefixes.cuts = False
    try:
        assert same(prefixes, library, table_text)
    finally:
        prefixes.cuts = True
    assert same(prefixes, library, text)


def test_a_place_has_one_last_token(prefixes, library):
    text = "▁internationalization"
    last = prefixes.last_tokens(text)
    for end in range(1, len(text) + 1):
        plain = library.encode(text[1:end])[-1] if end > 1 else None
        if plain is not None:
            assert last[end - 1] == plain


def test_forgetting_changes_nothing(prefixes, library, monkeypatch):
    monkeypatch.setattr(prefixtable, "REMEMBERED_WORDS", 3)
    monkeypatch.setattr(prefixtable, "REMEMBERED_PAIRS", 3)
    monkeypatch.setattr(prefixtable, "WORD_LENGTH", 4)
    for text in ("some words, and some words again", "and others 123456789"):
        assert same(prefixes, library, text)


def test_work_is_linear(prefixes):
    def seconds(length):
        start = time.perf_counter()
        prefixes.wrapped("xyz" * (length // 3))
        return time.perf_counter() - start

    seconds(300_000)
    assert seconds(1_200_000) < 12 * max(seconds(300_000), 0.02)


def test_rows(make_documents, library):
    found = prefixtable.encode(make_documents(EDGE_ROWS), piece_vocabulary()).collect()
    assert len(found) == len(EDGE_ROWS)
    expected = []
    for doc_id, text in EDGE_ROWS:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        expected.append((doc_id or -1, ids, library.decode(ids)))
    assert sorted((r.doc_id or -1, ids_of(r.ids), r.decoded) for r in found) == sorted(expected)
    assert all(r.decoded == "" for r in found if r.doc_id in (1, 2))


def test_empty_table(make_documents):
    assert prefixtable.encode(make_documents([]), piece_vocabulary()).count() == 0


def test_whole_table(spark, library):
    from hashlib import sha256

    from vacantia.llm.queries import op12_prefix_table

    folder = "/root/testdata/sf0.001"
    expected = set()
    for row in table(spark, folder, "documents").collect():
        ids = library.encode(row.text or "", add_bos=True, add_eos=True)
        octets = b"".join(i.to_bytes(4, "little") for i in ids)
        text = library.decode(ids).encode()
        expected.add((row.doc_id, len(ids), sha256(octets).hexdigest(), sha256(text).hexdigest()))
    assert {tuple(r) for r in op12_prefix_table(spark, folder).collect()} == expected
