"""Embedding whitening by matrix-free block subspace iteration.

Entries become the integers x = floor(1024 c) + 100000. The covariance of the x-vectors is never built: each Spark pass
computes V Q = X'(X Q) / n on centred rows, task by task, and adds the d x block sums. The driver orthogonalises (QR) and solves
the Rayleigh-Ritz problem over the block and the blocks before it (at most ``basis`` columns; then it restarts from the best ones);
the next block are the residuals of the leading Ritz vectors. It ends when the residuals of all components are
below ``tolerance`` times the largest eigenvalue. Keeping earlier blocks lets nearly equal eigenvalues, as those of random vectors are,
settle in a few passes; plain powers of V would need thousands.

Rows whose vector is null or has null or non-finite entries are dropped. Vectors shorter than the longest count as filled with
zeros. Entries beyond 2^43 in size count as that. Repeated rows count each; a null vec_id stays null. Components with an
eigenvalue of rounding size only (all rows equal in that direction) are not returned, so equal vectors or a single one give no
rows, nor do empty tables. A deviation beyond 64 bits is null. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Rows that are worked on at once; bounds a task's memory to a few times SLICE x d doubles.
SLICE = 2_048
LARGEST = float(2**43)


@dataclass(frozen=True)
class WhiteningParams:
    """``k`` components by blocks of ``block`` columns; ``basis``: columns that the driver keeps at most (at least 4 blocks)."""

    k: int = 8
    block: int = 16
    basis: int = 512
    tolerance: float = 1e-13
    passes: int = 500
    seed: int = 7


def _kept(vectors: DataFrame) -> DataFrame:
    e = F.col("embedding")
    bad = F.exists(e, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding")).where(e.isNotNull() & ~bad)


def slices(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer rows, at most SLICE at once."""
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            part = b.slice(at, SLICE)
            lists = part.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            c = np.zeros((part.num_rows, d))
            c[np.arange(d)[None, :] < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
            yield part.column("vec_id"), np.floor(1024 * np.clip(c, -LARGEST, LARGEST)).astype(np.int64) + 100_000


def _sums(d: int):
    """Of a task: the rows, and of each dimension the sums of the upper bits and of the lower 26, so that no sum overflows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in slices(batches, d):
            n, high, low = n + len(x), high + (x >> 26).sum(axis=0), low + (x & (2**26 - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(d)], pa.int32()), pa.array([n, *high.tolist()], pa.int64()), pa.array([0, *low.tolist()], pa.int64())], names=["i", "high", "low"])

    return run


def _product(mean: np.ndarray, q):
    """Of a task: X'(X Q) on centred rows, and the sum of their squares as one row more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = q.value
        d, b = block.shape
        out, squares = np.zeros((d, b)), 0.0
        for _, x in slices(batches, d):
            y = x - mean
            out += y.T @ (y @ block)
            squares += float((y * y).sum())
        rows = np.vstack([out, np.full((1, b), squares)])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(d + 1), b), pa.int32()), pa.array(np.tile(np.arange(b), d + 1), pa.int32()), pa.array(rows.ravel())], names=["i", "j", "v"])

    return run


def _added(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sums of all tasks' matrices: shape[0] x shape[1] numbers for the driver."""
    out = np.zeros(shape)
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


@dataclass(frozen=True)
class Components:
    n: int
    sums: list[int]
    trace: float
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _orthogonal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` adds to ``basis``; twice, for full precision."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        size = np.linalg.norm(block, axis=0)
        block = block[:, size > 0] / size[size > 0]
        if not block.shape[1]:
            return block
    q, r = np.linalg.qr(block)
    q = q[:, np.abs(np.diag(r)) > 1e-8]
    q -= basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def find_components(spark: SparkSession, vectors: DataFrame, p: WhiteningParams = WhiteningParams()) -> Components | None:
    """The leading eigenpairs of the covariance, by passes over ``vectors``; None without any vector."""
    kept = _kept(vectors)
    d = kept.agg(F.max(F.size("embedding"))).first()[0]
    if not d:
        return None
    found = {r.i: r for r in kept.mapInArrow(_sums(d), "i int, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    n, sums = found[-1].high, [(found[i].high << 26) + found[i].low for i in range(d)]
    mean = np.array([s / n for s in sums])
    start = np.random.default_rng(p.seed).standard_normal((d, min(d, max(p.block, p.k))))
    basis, image, q, trace = np.zeros((d, 0)), np.zeros((d, 0)), np.linalg.qr(start)[0], 0.0
    for passes in range(1, p.passes + 1):
        added = _added(kept.mapInArrow(_product(mean, spark.sparkContext.broadcast(q)), "i int, j int, v double"), (d + 1, q.shape[1])) / n
        trace = float(added[d, 0])
        basis, image = np.hstack([basis, q]), np.hstack([image, added[:d]])
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        ritz, mapped = basis @ turns, image @ turns
        k = min(p.k, len(values))
        apart = mapped - ritz * values
        residual = float(np.linalg.norm(apart[:, :k], axis=0).max())
        if trace <= 0 or residual <= p.tolerance * max(values[0], 0) or basis.shape[1] >= d:
            break
        if basis.shape[1] + p.block > max(p.basis, 4 * p.block):
            keep = 2 * p.block  # the best directions and their images, known without a pass
            basis, image = ritz[:, :keep], mapped[:, :keep]
        q = _orthogonal(apart[:, : p.block], basis)
        if not q.shape[1]:
            break
    else:
        raise ValueError(f"residual {residual} after {p.passes} passes")
    real = values[:k] > max(values[0], 0) * d * 1e-14
    return Components(n, sums, trace, values[:k][real], ritz[:, :k][:, real], residual, passes)


def _covariance(c: Components):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(c.values)
        out = np.zeros((k + 1, k))
        for _, x in slices(batches, len(c.sums)):
            w = (x - c.mean) @ c.vectors / np.sqrt(c.values)
            out[:k] += w.T @ w
            out[k] += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k + 1), k), pa.int32()), pa.array(np.tile(np.arange(k), k + 1), pa.int32()), pa.array(out.ravel())], names=["i", "j", "v"])

    return run


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2, exact: in 64 bits where they suffice, else in Python's integers; None beyond 64 bits."""
    if int(np.abs(x).max(initial=0)) * n < 2**62 and max(map(abs, sums)) < 2**62:
        apart = n * x - np.array(sums, np.int64)
        if int(np.abs(apart).max(initial=0)) ** 2 * len(sums) < 2**63:
            return (apart**2).sum(axis=1).tolist()
    exact = ((x.astype(object) * n - np.array(sums, object)) ** 2).sum(axis=1)
    return [v if v < 2**63 else None for v in exact]


def _whitened(c: Components, error: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(c.values)
        explained = c.values / c.trace
        for ids, x in slices(batches, len(c.sums)):
            w = (x - c.mean) @ c.vectors / np.sqrt(c.values)
            m = len(x)
            dev = pa.array(deviations(x, c.n, c.sums), pa.int64())
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [ids.take(each), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, c.n), pa.int64()), dev.take(each), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return run


def whiten(spark: SparkSession, vectors: DataFrame, p: WhiteningParams = WhiteningParams()) -> DataFrame:
    """One row for each kept vector and component, with the error of the whitened covariance over all rows."""
    c = find_components(spark, vectors, p)
    if c is None or not len(c.values):
        return spark.createDataFrame([], RESULT)
    kept, k = _kept(vectors), len(c.values)
    sums = _added(kept.mapInArrow(_covariance(c), "i int, j int, v double"), (k + 1, k)) / c.n
    error = float(np.abs(sums[:k] - np.outer(sums[k], sums[k]) - np.eye(k)).max())
    return kept.mapInArrow(_whitened(c, error), RESULT)
