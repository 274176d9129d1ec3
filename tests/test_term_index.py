import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vacantia.operators import matching, term_index
from vacantia.operators.term_index import WIDTH, TermIndex

WORDS = st.text(alphabet="aбé\0z", max_size=4) | st.sampled_from(["x" * WIDTH, "x" * (WIDTH + 1), "y" * 500])


@given(st.lists(WORDS, max_size=12), st.lists(st.tuples(WORDS, WORDS), max_size=8), st.lists(WORDS, max_size=12))
@settings(max_examples=300, deadline=None)
def test_lookups_are_those_of_sets(words, pairs, asked):
    written = [f"{a} {b}" for a, b in pairs]
    index = TermIndex.of(words, written)
    ids = index.ids(pa.array([*asked, *words, None], pa.string()))
    assert [i >= 0 for i in ids] == [w in set(words) for w in asked] + [True] * len(words) + [False]
    number = dict(zip(words, ids[len(asked) : len(asked) + len(words)].tolist()))
    assert len(set(number.values())) == len(set(words))
    for first in number:
        for second in number:
            known = index.know(np.array([number[first]]), np.array([number[second]]))[0]
            assert known == (f"{first} {second}" in written)


def test_an_index_of_nothing():
    index = TermIndex.of([], ["a b", "a", "a b c"])
    assert index.ids(pa.array(["a", None])).tolist() == [-1, -1]
    assert index.ids(pa.array([], pa.string())).tolist() == []
    assert index.know(np.array([0]), np.array([0])).tolist() == [False]


@pytest.mark.parametrize("low_order", [False, True])
def test_matching_is_that_of_sets(low_order):
    rng = random.Random(2)
    names = [f"w{i}" for i in range(60)] + ["long" * 20]
    words, pairs = names[:40] + names[60:], [f"{rng.choice(names)} {rng.choice(names)}" for _ in range(300)]
    texts = [" ".join(rng.choices([*names, ""], k=rng.randrange(30))) for _ in range(200)] + ["", None]
    found = matching.match_texts(pa.array(texts), TermIndex.of(words, pairs), low_order).to_pylist()
    for text, row in zip(texts, found):
        kept = [w for w in (text or "").split(" ") if w in set(words)]
        joined = [f"{a} {b}" for a, b in zip(kept, kept[1:])]
        hits = [p in set(pairs) for p in joined]
        assert row["unigrams"] == kept
        assert row["bigrams"] == [p for p, hit in zip(joined, hits) if hit]
        assert row["kept"] == ([w for w, hit in zip(kept, hits) if not hit] if low_order else kept)


def test_workers_map_one_shipped_index(spark):
    words = spark.createDataFrame([("a",), ("b",), ("c" * 100,), (None,)], "term string")
    pairs = spark.createDataFrame([("a b",), (None,)], "term string")
    name = term_index.ship_index(spark, words, pairs)

    def look(batches):
        for batch in batches:
            index = term_index.shipped_index(name)
            mapped = isinstance(index.terms, np.memmap) and isinstance(index.pairs, np.memmap)
            same = index is term_index.shipped_index(name)
            ids = index.ids(pa.array(["b", "c" * 100, "d", "a"]))
            fine = mapped and same and (ids >= 0).tolist() == [True, True, False, True]
            pair = index.know(ids[3:], ids[:1])[0] and not index.know(ids[:1], ids[3:])[0]
            yield pa.RecordBatch.from_pydict({"fine": [bool(fine and pair)] * batch.num_rows})

    assert all(r.fine for r in spark.range(8).repartition(4).mapInArrow(look, "fine boolean").collect())
