import math

import numpy as np
import pyarrow as pa

from quernstone.llm.cover_tree import CoverParams, vector_groups


def data():
    r = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for _ in range(30):
            rows.append((r.normal(size=16), label))
        for spread in (0.02, 0.06, 0.1):
            centre = r.normal(size=16)
            rows += [(centre + spread * r.normal(size=16), label) for _ in range(40)]
        rows += [(rows[-1][0], label)] * 5
    rows = [(i * 7 % 1009, [float(x) for x in v], y) for i, (v, y) in enumerate(rows)]
    big = max(i for i, _, _ in rows) + 1
    odd = [None, [], [0.0] * 16, [1.0, None] * 8, [math.nan] * 16, [math.inf] * 16, [1.0, 0.0], [2.0, 0.0], [1e-200, 0.0], [1e300, 1e300]]
    return rows + [(big + i, v, 0) for i, v in enumerate(odd)] + [(big + 20, rows[0][1], None), (None, rows[0][1], rows[0][2])]


def test_against_brute_force(spark):
    rows = data()
    real = [(i, np.array(v, float), y) for i, v, y in rows if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = [(i, v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()), y) for i, v, y in real]
    parent = {i: i for i, _, _ in rows if i is not None}
    links = dict.fromkeys(parent, 0)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, v, y in unit:
        for j, w, z in unit:
            if (i, j) != (j, i) and i is not None and y == z and len(v) == len(w) and (i != j) and v @ w >= 0.93:
                links[i] += 1
                if j is not None:
                    a, b = find(i), find(j)
                    parent[max(a, b)] = min(a, b)
    vectors = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, n int, unit string").repartition(3)
    for params in (CoverParams(), CoverParams(block=16, pivots=3, leaf=2, centres=8, piece=5)):
        got = vector_groups(spark, vectors, params).collect()
        assert len(got) == len(rows)
        assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == {i: (links[i], find(i)) for i in parent}
        assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert vector_groups(spark, vectors.limit(0)).count() == 0


def test_repeated_ids_are_vectors_of_their_own(spark):
    e = [float(i == 0) for i in range(8)], [float(i == 1) for i in range(8)]
    rows = [(1, e[0], 0), (1, e[1], 0), (2, e[1], 0), (3, [1.0, 0.01, *e[0][2:]], 0), (4, e[0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_groups(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]


def test_many_vectors_against_numpy(spark):
    r = np.random.default_rng(8)
    centres = r.normal(size=(300, 32))
    x = np.concatenate([r.normal(size=(8_000, 32)), centres[r.integers(0, 300, 12_000)] + r.normal(size=(12_000, 32)) * r.choice([0.02, 0.1, 0.2, 0.3], 12_000)[:, None]]).astype("f4")
    label = r.choice(4, len(x), p=[0.6, 0.2, 0.15, 0.05])
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want, parent = np.zeros(len(x), int), list(range(len(x)))

    def find(a):
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for k in range(4):
        at = np.flatnonzero(label == k)
        for low in range(0, len(at), 500):
            hit = u[at[low : low + 500]] @ u[at].T >= 0.93
            want[at[low : low + 500]] = hit.sum(1) - 1
            for i, j in zip(*np.nonzero(hit), strict=True):
                a, b = find(at[low + i]), find(at[j])
                parent[max(a, b)] = min(a, b)
    table = pa.table({"vec_id": np.arange(len(x)), "embedding": pa.FixedSizeListArray.from_arrays(x.ravel(), 32).cast(pa.list_(pa.float32())), "label": label})
    vectors = spark.createDataFrame(table)
    assert want.sum() > 100_000
    for params in (CoverParams(), CoverParams(block=512)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vector_groups(spark, vectors, params).collect()}
        assert got == {i: (want[i], find(i)) for i in range(len(x))}
