import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from vacantia.llm import components, simhash
from vacantia.llm.components import connected_components

from .conftest import EDGE_ROWS


def smallest_reachable(ids, prints, radius=3):
    """By comparing all pairs."""
    component = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, p in zip(ids, prints):
            for j, q in zip(ids, prints):
                if (p ^ q).bit_count() <= radius and component[i] > component[j]:
                    component[i] = component[j]
                    changed = True
    return component


def test_bits_by_definition(spark):
    text = "The Cat sat\ton the\x0bMat the cat sat on Éa"
    low = [w.encode().lower() for w in text.replace("\t", " ").replace("\x0b", " ").split(" ")]
    shingles = [b" ".join(low[i : i + 3]) for i in range(len(low) - 2)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    expected = sum(
        1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)
    )
    assert simhash.fingerprint(text) & (2**64 - 1) == expected
    row = spark.createDataFrame([(shingles[0].decode(),)], "s string").select(F.xxhash64("s")).first()
    assert row[0] & (2**64 - 1) == hashes[0]


def test_short_texts():
    one, two = (xxhash.xxh64_intdigest(s, 42) for s in (b"one", b"one two"))
    assert simhash.fingerprint("One") & (2**64 - 1) == one
    assert simhash.fingerprint(" one  TWO ") & (2**64 - 1) == two
    assert simhash.fingerprint(" \n") == 0


def test_tree_finds_all_within_the_radius():
    draw = random.Random(1)
    values = [draw.getrandbits(12) << 26 for _ in range(200)]
    values = list(dict.fromkeys(values))
    queries = np.array(values[::3], np.uint64)
    found = {(a, int(b)) for a, some in simhash.BKTree(values).near(queries, 3) for b in some}
    expected = {
        (a, b)
        for a, v in enumerate(values)
        for b, q in enumerate(queries.tolist())
        if (v ^ q).bit_count() <= 3
    }
    assert found == expected


def test_links_join_what_all_pairs_join(spark):
    draw = random.Random(2)
    prints = []
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(25):
            value = centre
            for bit in draw.sample(range(64), draw.randint(0, 5)):
                value ^= 1 << bit
            prints.append(value)
    prints = list(dict.fromkeys(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    classes = spark.createDataFrame(list(enumerate(signed)), "node long, print long").repartition(5)
    expected = smallest_reachable(range(len(prints)), prints)
    for tree_size in (4, 4096):
        made = connected_components(simhash.links(classes, tree_size)).collect()
        got = {i: i for i in range(len(prints))} | {r["node"]: r["component_id"] for r in made}
        assert got == expected


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(200, 260)] + [(7, 7)]
    table = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    got = {r["node"]: r["component_id"] for r in connected_components(table).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {i: 100 for i in range(200, 260)}


def test_edges(make_documents):
    got = simhash.near_duplicates(make_documents(EDGE_ROWS)).collect()
    by_id = {}
    for row in got:
        by_id.setdefault(row["doc_id"], []).append(row["component_id"])
    assert len(got) == len(EDGE_ROWS)
    assert by_id[1] == by_id[2] == by_id[3] == [1]
    assert by_id[4] == [4, 4] and by_id[5] == [5] and by_id[6] == [6]
    assert sorted(by_id[None], key=str) == [1, None]


def test_empty_table(make_documents):
    assert simhash.near_duplicates(make_documents([])).collect() == []


def test_given_table_against_all_pairs(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r["doc_id"]: (r["print"], r["component_id"]) for r in simhash.near_duplicates(documents).collect()}
    ids = sorted(got)
    expected = smallest_reachable(ids, [got[i][0] & (2**64 - 1) for i in ids])
    assert {i: got[i][1] for i in ids} == expected


def test_a_hub_is_split(spark, monkeypatch):
    """Half of all links hang on one node: the join back to it must be cut."""
    plans = []
    stage = components.stage

    def staged(table, name):
        written = stage(table, name)
        if name == "large":
            table.collect()
            plans.append(table._jdf.queryExecution().executedPlan().toString())
        return written

    monkeypatch.setattr(components, "stage", staged)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.files.maxPartitionBytes": "64k",
        "spark.sql.files.openCostInBytes": "1k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        links = spark.range(1, 200_001).select(
            F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") + 1_000_000).alias("a"),
            F.col("id").alias("b"),
        )
        found = components.connected_components(links)
        assert found.where("component_id = 0").count() == 100_000
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert "skew=true" in plans[0]
