"""Whitening against numpy's eigenvectors, and the awkward cases."""

import math

import numpy as np
import pytest

from quernstone.llm.whitening import WhiteningParams, deviations, find_components, whiten

SCHEMA = "vec_id long, embedding array<float>, label int, n int, mean string"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 0, 1, "m") for i, v in vectors], SCHEMA)


def expected(vectors, k=8):
    x = np.floor(1024 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 100_000
    y = x - x.sum(axis=0) / len(x)
    e, u = np.linalg.eigh(y.T @ y / len(x))
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return x, y @ u / np.sqrt(e), e / (y * y).sum() * len(x)


@pytest.mark.parametrize("shape", [(400, 12), (300, 90)])
def test_equals_numpy(spark, shape):
    r = np.random.default_rng(3)
    v = (r.standard_normal(shape) * np.linspace(1, 3, shape[1])).tolist()
    x, w, share = expected(v)
    rows = whiten(spark, frame(spark, list(enumerate(v))).repartition(3), WhiteningParams(block=8, basis=32)).collect()
    assert len(rows) == 8 * len(v) and {a.n for a in rows} == {len(v)} and all(a.identity_error < 1e-9 for a in rows)
    got = np.zeros_like(w)
    for a in rows:
        got[a.vec_id, a.component - 1] = a.whitened
        assert a.explained == pytest.approx(share[a.component - 1], rel=1e-9)
        assert a.deviation == sum(int(c) ** 2 for c in len(v) * x[a.vec_id] - x.sum(axis=0))
    assert np.abs(got * np.sign((got * w).sum(axis=0)) - w).max() < 1e-6


def test_residuals_certify_the_components(spark):
    r = np.random.default_rng(4)
    v = r.standard_normal((500, 60))
    c = find_components(spark, frame(spark, list(enumerate(v.tolist()))), WhiteningParams(k=4, block=4, basis=16))
    y = np.floor(1024 * v.astype(np.float32).astype(float)) + 100_000
    y -= y.mean(axis=0)
    cov = y.T @ y / len(y)
    assert np.linalg.norm(cov @ c.vectors - c.vectors * c.values, axis=0).max() < 1e-11 * c.values[0]
    assert np.abs(c.vectors.T @ c.vectors - np.eye(4)).max() < 1e-12 and c.trace == pytest.approx(np.trace(cov))


def test_awkward_rows(spark):
    bad = [(90, None), (91, [1.0, None]), (92, [math.nan, 1.0]), (93, [math.inf, 1.0])]
    good = [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [-0.25, 1.0]), (None, [0.0, 0.125]), (4, [0.75]), (5, [])]
    rows = whiten(spark, frame(spark, bad + good)).collect()
    assert len(rows) == 12 and {r.vec_id for r in rows} == {1, 2, None, 4, 5} and {r.n for r in rows} == {6}
    assert whiten(spark, frame(spark, bad)).count() == 0 and whiten(spark, frame(spark, [])).count() == 0
    assert whiten(spark, frame(spark, [(1, [0.5, 0.5])] * 3)).count() == 0  # no direction in which rows differ
    assert {r.component for r in whiten(spark, frame(spark, [(1, [0.5, 0.5]), (2, [1.0, 0.5])])).collect()} == {1}


def test_deviations_are_exact():
    x = np.array([[2**40, 5], [7, 2**41]], np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    assert deviations(x, 2, sums) == [None, None]
    x = np.array([[2**29, 5], [7, 2**30]], np.int64)
    sums = [int(s) for s in x.sum(axis=0)]
    assert deviations(x, 2, sums) == [sum((2 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
