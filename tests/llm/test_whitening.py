import math
from collections import defaultdict

import numpy as np
import pytest

from vacantia.llm import whitening
from vacantia.llm.common import table
from vacantia.llm.queries import op13_jacobi_davidson

SCHEMA = "vec_id long, embedding array<float>, x string, n string, component string"


def make(spark, rows):
    full = [(vec_id, vector, "x", "x", "x") for vec_id, vector in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def plain(rows):
    """{vec_id: (n, deviation, [whitened], [explained])} by numpy."""
    kept = [
        (i, [math.floor(256 * float(np.float32(c))) for c in v])
        for i, v in rows
        if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    width = max(len(v) for _, v in kept)
    kept = [(i, v + [0] * (width - len(v))) for i, v in kept]
    fit = np.array(sorted(set(tuple(v) for _, v in kept)), float)
    centred = fit - fit.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    values, vectors = values[::-1], vectors[:, ::-1]
    sums = [sum(int(row[d]) for row in fit) for d in range(width)]
    found = {}
    for i, v in kept:
        deviation = sum((len(fit) * c - s) ** 2 for c, s in zip(v, sums))
        white = (np.array(v) - fit.mean(axis=0)) @ vectors[:, :4] / np.sqrt(values[:4])
        found[i] = (len(fit), deviation, white, values[:4] / values.sum())
    return found


def compare(found, expected):
    by_id = defaultdict(dict)
    for r in found:
        by_id[r.vec_id][r.component] = r
    assert by_id.keys() == expected.keys()
    signs = None
    for vec_id, (n, deviation, white, explained) in sorted(expected.items()):
        rows = by_id[vec_id]
        assert sorted(rows) == [1, 2, 3, 4]
        got = np.array([rows[c].whitened for c in (1, 2, 3, 4)])
        if signs is None and np.abs(white).min() > 1e-3:
            signs = np.sign(got * white)
        assert all(r.n == n and r.deviation == deviation for r in rows.values())
        assert [rows[c].explained for c in (1, 2, 3, 4)] == pytest.approx(explained, rel=1e-9)
        assert np.abs(np.abs(got) - np.abs(white)).max() < 1e-7
        if signs is not None and np.abs(white).min() > 1e-3:
            assert (np.sign(got * white) == signs).all()
        assert all(r.identity_error < 1e-9 for r in rows.values())


def test_whole_table_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in table(spark, folder, "embeddings").collect()]
    compare(op13_jacobi_davidson(spark, folder).collect(), plain(rows))


def test_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 9)]) for i in range(60)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (102, [1.0, 2.0])]
    bad = [(200, None), (201, [None] * 9), (202, [float("nan")] * 9), (203, [1.0] * 8 + [float("inf")])]
    found = whitening.whiten(make(spark, rows + bad)).collect()
    compare(found, plain(rows))
    assert {r.n for r in found} == {61}


def test_repeated_rows_and_missing_ids_stay(spark):
    rows = [(i, [float(i % 7), float(i % 5), float(i % 3), float(i * i % 11)]) for i in range(40)]
    rows += [(None, rows[3][1]), (5, rows[5][1])]
    found = whitening.whiten(make(spark, rows)).collect()
    assert len(found) == 42 * 4
    assert sum(r.vec_id is None for r in found) == 4
    assert sum(r.vec_id == 5 for r in found) == 8


def test_without_variance_there_is_no_component(spark):
    assert whitening.whiten(make(spark, [])).count() == 0
    assert whitening.whiten(make(spark, [(1, None)])).count() == 0
    assert whitening.whiten(make(spark, [(1, [])])).count() == 0
    assert whitening.whiten(make(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    line = whitening.whiten(make(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(5)])).collect()
    assert {r.component for r in line} == {1}
    assert {round(r.explained, 9) for r in line} == {1.0}


def test_sums_beyond_longs_are_exact(spark):
    huge = [(1, [1e30, 1.0]), (2, [-1e30, 5.0]), (3, [3.0, 2.0]), (4, [1e30, 1.0])]
    found = whitening.whiten(make(spark, huge)).collect()
    assert {r.n for r in found} == {3}
    assert {r.vec_id for r in found if r.deviation is None} == {1, 2, 4}


@pytest.mark.parametrize("dimension", [1, 3, 6, 40, 90])
@pytest.mark.parametrize("shape", ["steep", "flat", "equal"])
def test_eigenpairs(dimension, shape):
    rng = np.random.default_rng(dimension)
    turn, _ = np.linalg.qr(rng.standard_normal((dimension, dimension)))
    values = {
        "steep": 1.0 / np.arange(1, dimension + 1) ** 2,
        "flat": np.linspace(2, 1, dimension),
        "equal": np.where(np.arange(dimension) < 3, 2.0, 1.0),
    }[shape]
    matrix = (turn * values) @ turn.T
    found, vectors = whitening.jacobi_davidson(lambda w: matrix @ w, dimension, 4)
    assert found == pytest.approx(values[:4], rel=1e-12)
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-13 * values[0] * 10
    assert np.abs(vectors.T @ vectors - np.eye(len(found))).max() < 1e-12


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    turn, _ = np.linalg.qr(rng.standard_normal((12, 12)))
    matrix = (turn * np.array([-3, -1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10.0])) @ turn.T
    right = rng.standard_normal((12, 3))
    right[:, 2] = 0
    found = whitening.minres(lambda w: matrix @ w, right, steps=40, reduction=1e-12)
    assert np.abs(matrix @ found - right).max() < 1e-9
