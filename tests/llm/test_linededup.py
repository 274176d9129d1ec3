import re

from vacantia.llm import linededup

from .conftest import CLASHING, EDGE_ROWS


def plain(rows):
    """(doc_id, text) with unique ids -> doc_id: (kept text, lines, dropped)."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    key_of = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line).translate(fold)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders.setdefault(key_of(line), set()).add(doc_id)
    found = {}
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [
            line for line in lines
            if len(holders.get(key_of(line), ())) < 2 or min(holders[key_of(line)]) == doc_id
        ]
        found[doc_id] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return found


def test_against_plain_python(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()]
    got = linededup.drop_repeated_lines(table).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got} == plain(rows)


def test_keys_strip_fold_and_count_code_points(make_documents):
    rows = [
        (1, "  Same LINE here\nother"), (2, "same line here \x0b\nééééééééé"),
        (3, "ééééééééé\nSAME line HERE\nsame line here"), (4, "éÉéééééééx"), (5, "éÉéééééééx"),
        (6, "\xa0same line here"),
    ]
    got = linededup.drop_repeated_lines(make_documents(rows)).collect()
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in got} == plain(rows)
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 1, 6: 0}


def test_edges_keep_columns_and_rows(make_documents):
    documents = make_documents([*EDGE_ROWS, (9, "one line of a row without an id")])
    got = linededup.drop_repeated_lines(documents)
    assert got.columns == [*documents.columns, "n_lines", "n_dropped"]
    assert set(CLASHING) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(EDGE_ROWS) + 1 and sum(r["n_dropped"] for r in rows) == 0
    assert [r["text"] for r in rows if r["doc_id"] == 1] == [None]
    assert [r["n_lines"] for r in rows if r["doc_id"] == 3] == [2]


def test_repeated_rows_of_one_document_lose_nothing(make_documents):
    rows = [(4, "a line that is repeated")] * 3 + [(8, "a line that is repeated")]
    got = linededup.drop_repeated_lines(make_documents(rows)).collect()
    assert sorted((r["doc_id"], r["n_dropped"]) for r in got) == [(4, 0), (4, 0), (4, 0), (8, 1)]


def test_higher_threshold_and_empty_table(make_documents):
    rows = [(i, "three documents hold it\nand a pair") for i in (1, 2, 3)] + [(4, "only twice here"), (5, "only twice here")]
    got = linededup.drop_repeated_lines(make_documents(rows), min_documents=3).collect()
    assert {r["doc_id"]: r["n_dropped"] for r in got} == {1: 0, 2: 2, 3: 2, 4: 0, 5: 0}
    assert linededup.drop_repeated_lines(make_documents([])).collect() == []
