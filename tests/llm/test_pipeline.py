import struct
import zlib

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from vacantia.llm import oracle, queries, simhash
from vacantia.scratch import stage

from .conftest import EDGE_ROWS
from .test_decontaminate import plain as leaks
from .test_fertility import plain_verdicts
from .test_linededup import plain as kept_lines
from .test_simhash import smallest_reachable

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage returns over the small tables."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = [docs]
    for name, apply in corpus_pipeline.STAGES:
        found.append(stage(apply(spark, found[-1], FOLDER), name))
    return found


def texts(table):
    return {r["doc_id"]: r["text"] for r in table.select("doc_id", "text").collect()}


def test_stages_in_order(stages):
    assert len(corpus_pipeline.STAGES) == 5
    assert all(table.columns == COLUMNS for table in stages[:-1])
    assert all(r["n_chars"] == len(r["text"]) for r in stages[2].collect())


def test_quality_rules(stages, vocabularies):
    rows = {r["doc_id"]: (r["text"], r["lang"]) for r in stages[0].collect()}
    kept = {doc_id for doc_id, (_, stays) in plain_verdicts(rows, vocabularies).items() if stays}
    assert set(texts(stages[1])) == kept


def test_line_dedup(stages):
    expected = {i: text for i, (text, _, _) in kept_lines(list(texts(stages[1]).items())).items()}
    assert texts(stages[2]) == expected


def test_near_dedup(stages):
    before = texts(stages[2])
    ids = sorted(before)
    prints = [simhash.fingerprint(before[i]) & (2**64 - 1) for i in ids]
    assert set(texts(stages[3])) == set(smallest_reachable(ids, prints).values())


def test_rows_that_repeat_an_id_are_the_smallest_text(spark, make_documents):
    rows = [(7, "b text of its own"), (7, "a text of its own"), (7, None), (8, "z"), (8, "y")]
    kept = corpus_pipeline.near_dedup(spark, make_documents(rows), FOLDER)
    assert texts(kept) == {7: None, 8: "y"}


def test_decontamination(spark, stages):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = texts(stages[3])
    found = {doc_id for doc_id, _ in leaks(list(before.items()), items)}
    assert set(texts(stages[4])) == set(before) - found


def test_packing(stages, vocabularies):
    library = Tokenizer.from_file(vocabularies[0])
    expected = set()
    for doc_id, text in texts(stages[4]).items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        for start in range(0, len(ids), 1024):
            part = ids[start : start + 1024]
            expected.add((doc_id, start, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part))))
    rows = stages[5].collect()
    assert {(r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == expected


def test_run_is_the_stages(spark, stages):
    names = ["doc_id", "start", "length", "ids_crc32"]
    run = corpus_pipeline.run(spark, FOLDER).select(*names).collect()
    assert sorted(map(tuple, run)) == sorted(map(tuple, stages[5].select(*names).collect()))


def test_edges(spark, make_documents):
    body = "this is a plain sentence about number {} with enough different words for every rule we have"
    rows = [*EDGE_ROWS, (20, body.format("one")), (20, body.format("one")), (None, body.format("two")), (21, body.format("one"))]
    docs = make_documents(rows)
    for _, apply in corpus_pipeline.STAGES[:-1]:
        made = stage(apply(spark, docs, FOLDER), "edges")
        assert made.columns == docs.columns
        docs = made
    assert sorted((r["doc_id"] for r in docs.collect()), key=str) == [20, 21, None] or sorted(
        (r["doc_id"] for r in docs.collect()), key=str
    ) == [20, None]


def test_empty_table(spark, make_documents):
    docs = make_documents([])
    for _, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, FOLDER), "empty")
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_queries_against_their_sql(spark, name):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    for table in ("documents", "pages", "labels", "benchmark"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    expected = connection.sql(oracle.oracle_sql()[name])
    made = queries.queries()[name](spark, folder)
    assert sorted(made.columns) == sorted(expected.columns)
    ordered = [tuple(row) for row in made.select(*expected.columns).collect()]
    assert sorted(ordered, key=str) == sorted(expected.fetchall(), key=str)
