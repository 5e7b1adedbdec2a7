"""Embedding near duplicates: exact threshold links by dual traversal of cover trees.

Vectors with equal components and label are one class; its copies are linked by definition. On unit vectors a cosine
is a distance, so covering radii bound it. The upper level of the tree is a table: per label a few pivots (fitted on
that bounded sample, every vector is assigned), cells around them with their covering radii, cut into blocks of bounded
size. Block pairs whose pivots are further apart than both radii and the threshold are pruned before a vector moves; the
others are one task each, to which vectors go in the form they came in (four bytes a component for floats). There each
block gets a tree of nested nets with halving radii, as long as a net has few centres; node pairs are pruned by their
covering radii, taken whole where the radii prove that every pair is a link, and otherwise split down to the leaves,
whose cosines are computed in double precision, piece by piece.

A task gives, for each class, how many it is linked with and one link to each part it connects, never the pairs:
a group of copies of any size yields rows in proportion to its members.

What the bounds can prune depends on the data. Vectors in tight groups are pruned above the tasks; vectors of a label
that are all about equally far apart (random ones in many dimensions) are not pruned by any covering radius, and each
then goes to as many tasks as its label has blocks.

Edge cases: vectors that are null, empty, zero or have null or non-finite components, and those with a null label,
link with nothing and stay; so do pairs of different lengths. Rows that repeat a vec_id are vectors of their own: each
has the links and the component of its own components and label. A row without vec_id counts and links like any
other, but never names a component (one that has no vec_id at all has a null component_id and is kept). Further columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType
from pyspark.sql.window import Window

from quernstone.llm.common import discard, join_hot, materialize
from quernstone.llm.graph import components


@dataclass(frozen=True)
class CoverParams:
    cosine: float = 0.93
    pivots: int = 16  # per label, for the upper level
    block: int = 4096  # classes a block
    centres: int = 64  # of a net within a block, at most
    leaf: int = 32  # a node of so few is not split
    piece: int = 1024  # rows whose cosines are held at once

    @property
    def distance(self) -> float:
        return float(np.sqrt(2 - 2 * self.cosine))


def packed(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector (packed components as they came; null for what links with nothing), dims of every row."""
    kind = vectors.schema["embedding"].dataType
    code = "f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "f8"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for v, label in zip(b.column("embedding").to_pylist(), b.column("label").to_pylist(), strict=True):
                ok = v and label is not None and None not in v
                x = np.array(v, dtype=code) + 0 if ok else np.zeros(0)  # no negative zeros
                out.append(x.tobytes() if ok and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(out, pa.binary())], ["vec_id", "label", "vector"])

    cast = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<float>" if code == "f4" else "array<double>"))
    rows = cast.mapInArrow(run, "vec_id long, label long, vector binary")
    return rows.withColumn("dims", (F.length("vector") * (1 if code == "f8" else -1)).cast("int"))  # below zero: floats


def units(some: Iterable[bytes], dims: int) -> np.ndarray:
    """Packed vectors as unit vectors in double precision."""
    x = np.frombuffer(b"".join(some), "f8" if dims > 0 else "f4").astype(float).reshape(-1, abs(dims) // (8 if dims > 0 else 4))
    x = x / np.abs(x).max(1, keepdims=True)  # so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


# --- a block's tree ---------------------------------------------------------------------------------------------


@dataclass
class Node:
    at: int  # its centre, a row of the block
    radius: float  # of the smallest ball around it with all its rows
    rows: np.ndarray
    children: list[Node]


def build(x: np.ndarray, rows: np.ndarray, centre: int, params: CoverParams) -> Node:
    """Nested nets: each level's centres are further apart than half the radius above, and cover all within that half.

    A node whose net would need more than ``centres`` of them is a leaf: its rows are too far apart to be told apart by balls.
    """
    away = np.sqrt(np.maximum(0, 2 - 2 * (x[rows] @ x[centre])))
    radius = float(away.max(initial=0.0)) + 1e-7  # rounding of the square root
    node = Node(centre, radius, rows, [])
    if len(rows) <= params.leaf or radius < 1e-6:
        return node
    nearest, owner = away.copy(), np.zeros(len(rows), dtype=np.int64)
    nearest[away > radius / 2] = np.inf
    found = [centre]
    while (open_ := np.flatnonzero(np.isinf(nearest))).size:
        if len(found) == params.centres:
            return node
        at = rows[open_[0]]
        d = np.sqrt(np.maximum(0, 2 - 2 * (x[rows[open_]] @ x[at])))
        d[0] = 0.0
        near = open_[d <= radius / 2]
        owner[near], nearest[near] = len(found), 0.0
        found.append(at)
    node.children = [build(x, own, c, params) for k, c in enumerate(found) if len(own := rows[owner == k])]
    return node


def traverse(x: np.ndarray, y: np.ndarray, p: Node, q: Node, same: bool, params: CoverParams) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """Row sets of both blocks and their links as a matrix (null: all are linked). ``same``: p and q are one node of one block."""
    r = params.distance
    d = 0.0 if same else float(np.sqrt(max(0.0, 2 - 2 * (x[p.at] @ y[q.at]))))
    if d > p.radius + q.radius + r + 1e-7:
        return
    if not same and d + p.radius + q.radius < r - 1e-6:
        yield p.rows, q.rows, None
    elif p.children or q.children:
        left, right = p.children or [p], q.children or [q]
        for i, a in enumerate(left):
            for j, b in enumerate(right):
                if not same or i <= j:
                    yield from traverse(x, y, a, b, same and i == j, params)
    else:
        size = params.piece
        for i in range(0, len(p.rows), size):
            for j in range(i if same else 0, len(q.rows), size):
                rows, cols = p.rows[i : i + size], q.rows[j : j + size]
                hit = x[rows] @ y[cols].T >= params.cosine
                yield rows, cols, np.triu(hit, 1) if same and i == j else hit


def task_links(ids: list[np.ndarray], x: list[np.ndarray], n: list[np.ndarray], params: CoverParams) -> pd.DataFrame:
    """id, links, to of the classes of one block (pairs within it) or two (pairs between them)."""
    same = len(ids) == 1
    trees = [build(v, np.arange(len(v)), 0, params) for v in x]
    at = (0, 0) if same else (0, 1)
    links = [np.zeros(len(i), dtype=np.int64) for i in ids]
    base = (0, len(ids[0]))
    parent = np.arange(sum(map(len, ids)))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    def join(a: int, b: int) -> None:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    for rows, cols, hit in traverse(x[at[0]], x[at[1]], trees[at[0]], trees[at[1]], same, params):
        left, right = base[at[0]], base[at[1]]
        if hit is None:
            np.add.at(links[at[0]], rows, n[at[1]][cols].sum())
            np.add.at(links[at[1]], cols, n[at[0]][rows].sum())
            for c in cols:
                join(left + rows[0], right + c)
            for c in rows[1:]:
                join(left + c, right + cols[0])
        elif hit.any():
            np.add.at(links[at[0]], rows, hit @ n[at[1]][cols])
            np.add.at(links[at[1]], cols, n[at[0]][rows] @ hit)
            for i, j in zip(*np.nonzero(hit), strict=True):
                join(left + rows[i], right + cols[j])
    every, count = np.concatenate(ids), np.concatenate(links)
    keep = np.flatnonzero(count)
    return pd.DataFrame({"id": every[keep], "links": count[keep], "to": every[[find(int(i)) for i in keep]] if len(keep) else every[:0]}).astype("int64")


# --- all of it --------------------------------------------------------------------------------------------------


def vector_groups(spark: SparkSession, vectors: DataFrame, params: CoverParams = CoverParams()) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors`` (vec_id, embedding, label)."""
    group = ["label", "dims"]
    rows = materialize(spark, packed(vectors), "packed")
    known = rows.where("vector is not null").groupBy(*group, "vector").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"))
    classes = materialize(spark, known.withColumn("id", F.monotonically_increasing_id()), "vectors")  # written, so the ids stay

    by_hash = Window.partitionBy(*group).orderBy(F.xxhash64("vector"), "id")
    pivots = classes.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= params.pivots)
    # no more cells than the label has blocks: what smaller ones would save in cosines, they would cost in copies
    sizes = classes.groupBy(*group).agg(F.ceil(F.count("*") / params.block).cast("int").alias("blocks"))
    pivots = pivots.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("rank", "vector"))).alias("pivots")).join(sizes, group)  # a few a label
    pivots = pivots.select(*group, F.slice("pivots", F.lit(1), F.least("blocks", F.lit(params.pivots))).alias("pivots"))

    @F.pandas_udf("cell int, away double")
    def assign(x: pd.Series, p: pd.Series, dims: pd.Series) -> pd.DataFrame:
        out, known = [], {}
        for v, some, n in zip(x, p, dims, strict=True):
            key = (n, some[0]["vector"])
            if key not in known:
                if len(known) > 256:
                    known.clear()
                known[key] = units([q["vector"] for q in some], n)
            c = known[key] @ units([v], n)[0]
            best = int(c.argmax())
            out.append((best, float(np.sqrt(max(0.0, 2 - 2 * c[best])))))
        return pd.DataFrame(out, columns=["cell", "away"])

    placed = classes.join(F.broadcast(pivots) if pivots.limit(2_001).count() <= 2_000 else pivots, group)
    placed = placed.withColumn("at", assign("vector", "pivots", "dims")).select(*group, "id", "n", "vector", "at.cell", "at.away", F.expr("pivots[at.cell].vector").alias("pivot"))
    placed = materialize(spark, placed, "placed")
    cells = placed.groupBy(*group, "cell").agg(F.ceil(F.count("*") / params.block).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(cells) if cells.limit(50_001).count() <= 50_000 else cells, [*group, "cell"])
    dealt = dealt.withColumn("block", F.concat_ws(".", "cell", F.pmod(F.xxhash64("id"), F.col("parts"))))
    blocks = dealt.groupBy(*group, "block").agg(F.max("away").alias("radius"), F.min("pivot").alias("pivot"), F.count("*").alias("size"))
    blocks = materialize(spark, blocks, "blocks")

    @F.pandas_udf("double")
    def apart(p: pd.Series, q: pd.Series, dims: pd.Series) -> pd.Series:
        return pd.Series([float(np.sqrt(max(0.0, 2 - 2 * (units([a], n)[0] @ units([b], n)[0])))) for a, b, n in zip(p, q, dims, strict=True)], dtype=float)

    two = blocks.alias("a").join(blocks.alias("b"), group).where("a.block <= b.block")
    two = two.select(*group, F.col("a.block").alias("left"), F.col("b.block").alias("right"), (F.col("a.radius") + F.col("b.radius")).alias("reach"), apart("a.pivot", "b.pivot", "dims").alias("gap"))
    pairs = two.where(F.col("gap") <= F.col("reach") + params.distance + 1e-7).select(*group, "left", "right")
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("left", "right"))))
    tasks = sides.join(dealt.select(*group, "block", "id", "n", "vector"), [*group, "block"])

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        parts = [g for _, g in b.groupby("block")]
        if len(parts) == 1 and key[2] != key[3]:
            return pd.DataFrame({"id": [], "links": [], "to": []}, dtype="int64")
        return task_links([g["id"].to_numpy() for g in parts], [units(g["vector"], key[1]) for g in parts], [g["n"].to_numpy() for g in parts], params)

    found = materialize(spark, tasks.groupBy(*group, "left", "right").applyInPandas(run, "id long, links long, to long"), "found")
    roots = components(spark, found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    own = classes.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    own = own.select(*group, "vector", "vec_id", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("found"), F.coalesce("root", "id").alias("root"))
    own = materialize(spark, own, "roots")
    discard(spark, roots)
    first = materialize(spark, own.groupBy("root").agg(F.min("vec_id").alias("component"), F.count("*").alias("classes")).where("classes > 1"), "first")
    key = F.sha2(F.concat_ws(":", F.col("label").cast("string"), F.col("dims").cast("string"), F.hex("vector")), 256).alias("key")
    linked = join_hot(own, first, "root", own.count(), "classes").select(key, "found", "component", "n")
    alone = own.join(first.select("root"), "root", "left_anti").select(key, "found", F.col("vec_id").alias("component"), "n")
    judged = materialize(spark, linked.unionByName(alone), "judged")
    real = join_hot(rows.where("vector is not null").select("vec_id", key), judged, "key", rows.count())
    real = real.select("vec_id", F.col("found").cast("long").alias("n_links"), F.col("component").alias("component_id"))
    none = rows.where("vector is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for df in (classes, own, first, placed, blocks, found):
        discard(spark, df)
    return real.unionByName(none).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
