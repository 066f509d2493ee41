"""Embedding whitening against a plain decomposition of all rows."""

import math

import numpy as np
import pytest

from tomewright.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, `key` string, x string, size int, deviation string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "k", "x", 1, "d") for i, v in rows], SCHEMA)


def brute(values):
    x = np.floor(np.asarray(values, np.float64) * 1024) + 100_000
    apart = x - x.mean(axis=0)
    # Eigenvectors of the covariance, without squaring the condition of the rows.
    _, singular, directions = np.linalg.svd(apart, full_matrices=False)
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    deviation = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    return apart, singular**2 / len(x), directions.T, deviation


def check(spark, rows, count, most=whitening.COMPONENTS):
    got, model = whitening.whiten(vectors(spark, rows), most)
    got = got.collect()
    apart, e, directions, deviation = brute([v for _, v in rows])
    want = apart @ directions[:, :count] / np.sqrt(e[:count])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    order = sorted(range(len(rows)), key=lambda k: key((rows[k][0], deviation[k])))
    got = sorted(got, key=lambda r: key((r.vec_id, r.deviation)))
    assert [(r.vec_id, r.deviation) for r in got] == [(rows[k][0], deviation[k]) for k in order]
    found = np.array([r.whitened for r in got]).reshape(len(rows), count)
    sign = np.sign((found * want[order]).sum(axis=0))
    assert np.abs(found * sign - want[order]).max(initial=0) < 1e-8
    assert np.abs(model.explained - e[:count] / e.sum()).max(initial=0) < 1e-9 and model.identity_error < 1e-9
    return model


def test_query_matches_eigenvectors(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    check(spark, rows, 8)
    got = whitening.query(spark, sf).toPandas()
    assert len(got) == 8 * len(rows) and set(got["component"]) == set(range(1, 9)) and set(got["n"]) == {len(rows)}
    each = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(each.T, bias=True) - np.eye(8)).max() < 1e-9
    assert got["explained"].between(0, 1).all() and (got["identity_error"] < 1e-4).all()


def test_badly_conditioned_vectors(spark):
    made = np.random.default_rng(1)
    basis = np.linalg.qr(made.normal(size=(6, 6)))[0]
    values = (made.normal(size=(400, 6)) * 10.0 ** -np.arange(6)[None, :] * 300) @ basis
    check(spark, list(enumerate(values.astype(np.float32).tolist())), 6)


def test_flat_directions_are_no_components(spark):
    made = np.random.default_rng(2)
    plane = made.integers(-50, 50, (60, 2)).astype(float)
    rows = [[float(a), float(b), float(a + b), 7.0] for a, b in plane]
    check(spark, list(enumerate(rows)), 2)
    check(spark, list(enumerate(rows)), 1, most=1)


def test_corner_rows(spark):
    good = [[float(i % 7), float(i * i % 11), -float(i % 3)] for i in range(20)]
    rows = [*enumerate(good), (3, good[3]), (None, good[5])]
    bad = [(50, None), (51, [1.0, None, 2.0]), (52, [1.0, math.nan, 2.0]), (53, [1.0, math.inf, 2.0]), (54, [1e30, 1.0, 1.0]), (55, []), (56, [1.0])]
    got, model = whitening.whiten(vectors(spark, rows + bad))
    assert model.centre.n == 22 and sorted(got.columns) == ["deviation", "vec_id", "whitened"]
    check(spark, rows, 3)
    assert sorted(str(r.vec_id) for r in got.collect()) == sorted(str(i) for i, _ in rows)
    for few in ([], bad[:6]):
        got, model = whitening.whiten(vectors(spark, few))
        assert got.count() == 0 and model is None
    got, model = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]))
    assert [(r.deviation, r.whitened) for r in got.collect()] == [(0, []), (0, [])]
    assert len(model.components) == 0


def test_deviation_beyond_a_long_is_null():
    centre = whitening.Centre.of(1 << 20, [(1 << 20) * (1 << 30)] * 2)
    x = np.array([[1 << 30, 1 << 30], [(1 << 30) + (1 << 10), 1 << 30], [0, 0]], np.int64)
    assert centre.deviations(x) == [0, 1 << 60, None]


def test_solved_undoes_the_triangle():
    made = np.random.default_rng(3)
    upper, rows = np.triu(made.normal(size=(5, 5))) + 5 * np.eye(5), made.normal(size=(9, 5))
    assert whitening.solved(rows @ upper, upper) == pytest.approx(rows)
    with_shift = whitening.factor(np.diag([1.0, 0.0]), 1e-6)
    assert np.allclose(with_shift.T @ with_shift, np.diag([1.0, 0.0]), atol=1e-5)
