import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from vacantia.llm import fertility

from .conftest import EDGE_ROWS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {
        i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)
    }
    lines = (text or "").split("\n")
    repeated = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, repeated, len(inside)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=30))
def test_repeated_words(words):
    assert fertility.repeated_words(words) == plain_counts(" ".join(words))[4]


def test_base_counts_against_plain_python(spark, vocabularies):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    for row in fertility.judge(table, *vocabularies).collect():
        expected = plain_counts(texts[row["doc_id"]])
        assert tuple(row[c] for c in COUNTS) == expected
        assert row["base_failed"] == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])


def test_clean_labelled_documents_stay(spark, vocabularies):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = fertility.judge(table, *vocabularies).join(labels, "doc_id").where("NOT base_failed").collect()
    good = [r["kept"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert all(good) and sum(bad) < 0.6 * len(bad)


def test_a_text_unlike_its_language_is_rejected(make_documents, vocabularies):
    draw = random.Random(3)
    words = "the house of a river and small tree with good water in our old town by night".split()
    rows = [(i, " ".join(draw.choices(words, k=400))) for i in range(40)]
    rows.append((100, " ".join("".join(draw.choices("qxzjkvw", k=9)) for _ in range(400))))
    rows.append((101, " ".join("".join(draw.choices("漢字仮名交文", k=6)) for _ in range(400))))
    got = {r["doc_id"]: r["kept"] for r in fertility.judge(make_documents(rows), *vocabularies).collect()}
    assert got == {i: i < 100 for i in got} and len(got) == 42


def test_edges(make_documents, vocabularies):
    rows = [*EDGE_ROWS, (8, "a text of more than ten words that has no language at all", None)]
    got = fertility.judge(make_documents(rows), *vocabularies).collect()
    assert len(got) == len(rows)
    for row, (_, text, *_) in zip(
        sorted(got, key=lambda r: (r["doc_id"] or 0, r["n_words"])),
        sorted(rows, key=lambda r: (r[0] or 0, len(WORD.findall(r[1] or "")))),
    ):
        if len(text or "") < 1000:
            assert tuple(row[c] for c in COUNTS) == plain_counts(text)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[8] and not kept[1] and not kept[2] and not kept[5]
    assert fertility.judge(make_documents([]), *vocabularies).collect() == []


def test_language_column_may_be_missing(make_documents, vocabularies):
    rows = make_documents([(1, "ten words are enough for the rules to look at it")]).drop("lang")
    assert [r["kept"] for r in fertility.judge(rows, *vocabularies).collect()] == [True]


def plain_measures(text, byte_level, pieces):
    """The measures word by word with the libraries themselves."""
    words = WORD.findall(text or "")
    plain = [w for w in words if not re.search("[0-9]", w)]
    ids = [i for w in plain for i in byte_level.encode(" " + w, add_special_tokens=False).ids]
    parts = [p for w in plain for p in pieces.encode(w)]
    fallback = sum(pieces.is_byte(p) for p in parts)
    chars, every = sum(map(len, plain)), sum(map(len, words))
    shares = [n / len(ids) for n in Counter(ids).values()]
    spread = -sum(p * math.log(p) for p in shares) / math.log(min(len(ids), 1024)) if len(ids) > 1 else 1.0
    return {
        "token_chars": chars / max(1, len(ids)), "piece_chars": chars / max(1, len(parts)),
        "byte_share": fallback / max(1, len(parts)), "entropy": spread,
        "digit_words": (len(words) - len(plain)) / max(1, len(words)),
        "digit_chars": (every - chars) / max(1, every),
    }, len(ids)


def plain_verdicts(texts, vocabularies):
    """{doc_id: (text, lang)} -> {doc_id: (measures, kept)}, all by counting."""
    byte_level, pieces = Tokenizer.from_file(vocabularies[0]), SentencePieceProcessor(model_file=vocabularies[1])
    own = {d: plain_measures(text, byte_level, pieces) for d, (text, _) in texts.items()}
    counts = {d: plain_counts(text) for d, (text, _) in texts.items()}
    failed = {d: c[0] < 10 or 100 * c[4] > 20 * c[0] for d, c in counts.items()}
    names = list(fertility.MIN_SPREAD)
    limits = {}
    for lang in {lang for _, lang in texts.values()}:
        inside = [own[d][0] for d in texts if texts[d][1] == lang and not failed[d]]
        for name in names:
            grid = [math.floor(m[name] * 256 + 0.5) / 256 for m in inside]
            low, middle, high = np.percentile(grid, [25, 50, 75])
            limits[lang, name] = middle, max((high - low) / 2, fertility.MIN_SPREAD[name])
    verdicts = {}
    for d, (found, tokens) in own.items():
        out = False
        for name in names:
            middle, spread = limits[texts[d][1], name]
            shares = name in ("digit_words", "digit_chars")
            slack = 60 / math.sqrt(max(1, counts[d][0])) if shares else 26 / math.sqrt(max(1, tokens))
            reach = (fertility.BAND_WIDTH[name] + slack) * spread
            if shares or name == "byte_share":
                out |= found[name] > middle + reach
            else:
                out |= tokens > 0 and found[name] < middle - reach
        verdicts[d] = found, not failed[d] and not out
    return verdicts


def test_measures_and_verdicts_by_brute_force(spark, vocabularies):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    verdicts = plain_verdicts({r["doc_id"]: (r["text"], r["lang"]) for r in table.collect()}, vocabularies)
    for row in fertility.judge(table, *vocabularies).collect():
        found, kept = verdicts[row["doc_id"]]
        assert {name: row[name] for name in found} == pytest.approx(found, abs=1e-12)
        assert row["kept"] == kept, row


def test_keys_between_clean_words_are_rejected(spark, vocabularies):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1")
    clean = table.join(labels, "doc_id", "left_semi").where("lang = 'en'")
    clean = clean.where("length(text) between 1500 and 4000").orderBy("doc_id").limit(5).collect()
    draw = random.Random(9)
    hexes = [" ".join("".join(draw.choices("0123456789abcdef", k=16)) for _ in range(5000)) for _ in clean]
    keys = [" ".join("".join(draw.choices("ABCDEFabcdefXYZxyz0123456789+/", k=24)) for _ in range(200)) for _ in clean]
    blobs = ["".join(draw.choices("ABCDEFabcdefXYZxyz0123456789+/", k=50_000)) for _ in clean]
    rows = []
    for k, junk in enumerate((["call +1 (372) 555-7739"] * 5, hexes, keys, blobs)):
        rows += [(10**9 + 10 * k + i, f"{r.text} {j}", "en", "s", 1) for i, (r, j) in enumerate(zip(clean, junk))]
    planted = table.unionByName(spark.createDataFrame(rows, table.schema))
    judged = fertility.judge(planted, *vocabularies).where(f"doc_id >= {10**9}").collect()
    kept = {r["doc_id"] - 10**9: r["kept"] for r in judged}
    assert len(clean) == 5 and kept == {10 * k + i: k == 0 for k in range(4) for i in range(5)}
