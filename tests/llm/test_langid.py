import zlib

from pyspark.sql import functions as F

from vacantia.llm import langid

from .conftest import EDGE_ROWS

WORDS = {
    "en": "the house and the river are with them while nobody thought of it",
    "de": "das haus und der fluss sind bei ihnen während niemand daran gedacht hat",
    "es": "la casa y el río están con ellos mientras nadie pensaba en eso",
    "fr": "la maison et la rivière sont avec eux alors que personne n'y pensait",
    "xx": "zuk zuk mub mub zub muk kuz bum zuku mubu",
}


def corpus(n=40):
    rows = []
    for k, (lang, text) in enumerate(WORDS.items()):
        words = text.split()
        rows += [(1000 * k + i, " ".join((words[i % len(words) :] + words)[:9]), lang) for i in range(n)]
    return rows


def test_held_out_accuracy_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(table).join(table.select("doc_id", "lang"), "doc_id").collect()
    for row in rows:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2)
        assert 0 <= row["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 150 and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_families_and_languages(make_documents):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(make_documents(corpus())).collect()}
    right = [got[doc_id] == lang for doc_id, _, lang in corpus()]
    assert sum(right) >= 0.98 * len(right)
    assert langid.family("de") == langid.family("en") != langid.family("fr") and langid.family("xx") == "xx"


def test_held_out_languages_and_labels_are_not_used(make_documents):
    rows = corpus()
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    changed = [(r[0], r[1], "qq" if h else r[2]) for r, h in zip(rows, held)]
    one = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(make_documents(rows)).collect()}
    two = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(make_documents(changed)).collect()}
    assert one == two


def test_edges(make_documents):
    rows = [*corpus(), *[(d if d is None else 90_000 + d, t, None) for d, t in EDGE_ROWS], (99_000, "12 !? 34", "en")]
    got = langid.identify(make_documents(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for doc_id in (90_001, 90_002, 90_003, 99_000):
        assert by_id[doc_id]["lang_pred"] == "und" and by_id[doc_id]["score"] == 0
    assert by_id[90_005]["lang_pred"] in WORDS and not by_id[None]["held_out"]


def test_nothing_to_learn_from(make_documents):
    assert langid.identify(make_documents([])).collect() == []
    only = langid.identify(make_documents([(1, "some text", None)])).collect()
    assert [(r["lang_pred"], r["score"]) for r in only] == [("und", 0.0)]
    one = langid.identify(make_documents([(1, "some text", "en"), (3, "more text", "en")])).collect()
    assert {r["lang_pred"] for r in one} == {"en"}


def test_long_texts_count_to_their_end(monkeypatch):
    text = "abc déf " * 500
    whole, _ = langid.features([text])
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 100)
    pieces, lettered = langid.features([text])
    assert lettered.all() and abs(whole - pieces).max() < 0.05


def test_fold_of_the_id(spark):
    ids = spark.range(200).select(F.col("id"), langid.held_out(F.col("id")).alias("held")).collect()
    assert all(r["held"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in ids)


def test_copies_do_not_thin_the_sample(make_documents, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_PER_LANGUAGE", 20)
    few = [(d, f"{t} {'abcdefghij'[d % 10] * 3}", lang) for d, t, lang in corpus(30)]
    copies = [(50_000 + i, "zuk mub zuk mub zub", "xx") for i in range(20_000)]
    plain, skewed = langid.fit(make_documents(few)), langid.fit(make_documents([*few, *copies]))
    assert plain.languages == skewed.languages == sorted(WORDS)


def test_more_languages_than_are_learnt(make_documents, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    rows = [r for r in corpus(12) if r[2] in ("en", "fr")]
    rows += [(90_000 + 4 * i, "the word", f"z{i}") for i in range(5)]
    got = langid.identify(make_documents(rows)).collect()
    assert len(got) == len(rows) and {r["lang_pred"] for r in got} == {"en", "fr"}


def test_rare_letters_are_letters(make_documents):
    rows = [r for r in corpus(12) if r[2] in ("en", "fr")] + [(70_001, chr(0x30010) * 5, None)]
    rows.append((70_002, chr(0xE0100) * 5, None))
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(make_documents(rows)).collect()}
    assert got[70_001] in ("en", "fr") and got[70_002] == "und"
    one, other = (langid.features([chr(point) * 5])[0] for point in (0x30010, 0x30011))
    assert abs(one - other).max() > 0.1


def test_the_bounds_of_the_sample_are_parameters(make_documents):
    rows = [r for r in corpus(12) if r[2] in ("en", "fr")]
    assert langid.fit(make_documents(rows), max_languages=1).languages == ["en"]
    small = langid.fit(make_documents(rows), per_language=8, total=16)
    assert small.languages == ["en", "fr"]
