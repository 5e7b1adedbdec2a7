"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full shingle sets.

1. Each text gets its set of five-word shingles (64-bit hashes) and a signature of ``trees`` x ``depth`` minima. Texts
   with equal word sequences are one class, whatever their doc_ids; all that follows works on classes.
2. Forest: each tree orders the classes by its own minima. Classes with a common prefix of ``least`` minima are a region
   of that order; a region of more than ``region`` classes goes one minimum deeper, again and again, so that the depth
   adapts to how crowded a part of the order is. What is still larger at full depth (classes that agree in all of a
   tree's minima) is dealt into cells of the same bounded size, differently in every tree. Only counts are grouped.
3. Sweeps: within a cell, which is in the tree's order, every class meets its neighbours with the longest common prefix.
   Pairs of classes of different components whose sketches agree too little to reach the threshold (four standard
   errors off) are left out. The first two sweeps take each class to one of its cells only, so that its shingle set
   moves once; the last takes each pair that is still open to one of its cells. Pairs are confirmed on full sets, longest
   common prefix first; what is connected already is skipped.
4. Regions that were dealt into cells: what isn't in the region's largest component yet is compared with all of the
   region, part by part. Nothing is capped: crowded regions cost more depth, cells or parts.

The union of confirmed links gives the components. The probability that a pair at exactly the threshold of 0.75 shares
no region with 20 trees is 2e-5 at depth 3, 0.005 at 5 and 0.06 at 7 (0.01 at 7 for a pair at 0.8), if nothing else
links the two. The test of recall measures it against brute force.

Edge cases: texts that are null, empty or white space have an empty set, link with nothing and are kept; fewer than
five words are one shingle. Rows that repeat a doc_id with different texts are judged by their own texts: each has its
text's component, and kept says whether that has this doc_id. Rows with a null doc_id get the component of their text's
class, never link other texts, and are kept only if no row with a doc_id has their text. Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.batches import portions
from quernstone.llm.common import LOWER, UPPER, batch_rows, discard, join_hot, materialize
from quernstone.llm.graph import components


@dataclass(frozen=True)
class NearDupParams:
    words: int = 5
    percent: int = 75  # link where 100 * intersection >= percent * union
    trees: int = 20
    depth: int = 7
    least: int = 3  # minima that a region's members share
    deeper: int = 2  # minima more that those of a crowded region share
    region: int = 128  # classes that a region may hold before it goes deeper, and a cell
    batch: int = 1024  # texts or shingle sets of an Arrow batch
    broadcast_mb: int = 64  # ids above this estimate are joined by a shuffle

    @property
    def hashes(self) -> int:
        return self.trees * self.depth

    def agree(self) -> int:
        """Equal minima that a pair at the threshold has, less four standard errors."""
        p = self.percent / 100
        return int(self.hashes * p - 4 * (self.hashes * p * (1 - p)) ** 0.5)


def shingles(text: str | None, n: int) -> tuple[np.ndarray, bytes | None]:
    """Sorted distinct shingle hashes of a text, and a key of its word sequence (null for none)."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.zeros(0, np.uint64), None
    h = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    n = min(n, len(tokens))
    acc = np.full(len(tokens) - n + 1, n, dtype=np.uint64)
    for i in range(n):
        acc = acc * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
        acc ^= acc >> np.uint64(29)
    return np.unique(acc), hashlib.md5(b" ".join(tokens), usedforsecurity=False).digest()


def signatures(sets: list[np.ndarray], params: NearDupParams) -> np.ndarray:
    """[sets, hashes] the last 16 bits of each minimum (its first ones say how large the set is); no set may be empty."""
    rng = np.random.default_rng(20_240_601)
    factors = rng.integers(1, 2**63, params.hashes, dtype=np.uint64) | np.uint64(1)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), params.hashes), dtype=np.uint16)
    flat = flat ^ (flat >> np.uint64(31))
    for i, f in enumerate(factors):
        out[:, i] = np.minimum.reduceat((flat * f) >> np.uint64(16), starts).astype(np.uint16)
    return out


def signed(docs: DataFrame, params: NearDupParams) -> DataFrame:
    """doc_id, n_shingles, key, sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_pylist()
            for low, texts in zip(range(0, len(ids), 256), portions(b.column("text")), strict=True):
                made = [shingles(t, params.words) for t in texts]
                real = [i for i, (s, _) in enumerate(made) if len(s)]
                sig: list[bytes | None] = [None] * len(made)
                if real:
                    for i, row in zip(real, signatures([made[i][0] for i in real], params), strict=True):
                        sig[i] = row.astype(">u2").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[low : low + 256], pa.int64()), pa.array([len(s) for s, _ in made], pa.int64()), pa.array([k for _, k in made], pa.binary()), pa.array(sig, pa.binary())],
                    ["doc_id", "n_shingles", "key", "sig"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, key binary, sig binary")


# --- the forest -------------------------------------------------------------------------------------------------


def cells(spark: SparkSession, classes: DataFrame, params: NearDupParams) -> DataFrame:
    """(cell, id, own, region): the classes of each cell of two or more; ``own``: the tree's minima, by which it is
    ordered; ``region``: null, or of which region at full depth the cell is a part."""
    wide = params.depth * 2
    orders = F.array(*[F.struct(F.lit(t).cast("short").alias("tree"), F.substring("sig", t * wide + 1, wide).alias("own")) for t in range(params.trees)])
    every = classes.select("id", F.explode(orders).alias("o")).select("id", "o.tree", "o.own")
    region = lambda depth: F.xxhash64(F.lit(depth), "tree", F.substring("own", 1, depth * 2))
    here = every.withColumn("region", region(params.least))
    sizes = materialize(spark, here.groupBy("region").agg(F.count("*").alias("n")).where("n > 1"), "regions")
    members = materialize(spark, join_hot(here, sizes, "region", classes.count() * params.trees), "members")
    spent = [sizes, members]
    none = F.lit(None).cast("long").alias("region")
    out = members.where(F.col("n") <= params.region).select(F.col("region").alias("cell"), "id", "own", none)
    crowded = members.where(F.col("n") > params.region)
    total = crowded.count()
    if total and params.depth > params.least:
        # the classes of crowded regions: the sizes of all deeper regions at once, then the first that is not crowded
        depths = [*range(params.least + params.deeper, params.depth, params.deeper), params.depth]
        deeper = F.array(*[F.struct(F.lit(d).alias("depth"), region(d).alias("region")) for d in depths])
        below = crowded.select("id", "tree", "own", F.explode(deeper).alias("d")).select("id", "tree", "own", "d.depth", "d.region")
        sizes = materialize(spark, below.groupBy("region").agg(F.count("*").alias("n")).where("n > 1"), "regions")
        placed = join_hot(below, sizes, "region", total * len(depths), how="left").withColumn("n", F.coalesce("n", F.lit(1)))
        fits = placed.where((F.col("n") <= params.region) | (F.col("depth") == params.depth))
        crowded = fits.groupBy("id", "tree").agg(F.min(F.struct("depth", "region", "n", "own")).alias("p")).select("id", "tree", "p.region", "p.n", "p.own").where("n > 1")
        crowded = materialize(spark, crowded, "deep")
        spent += [sizes, crowded]
        out = out.unionByName(crowded.where(F.col("n") <= params.region).select(F.col("region").alias("cell"), "id", "own", none))
    dealt = F.xxhash64("region", F.pmod(F.xxhash64("id", "tree"), F.ceil(F.col("n") / params.region)))
    out = out.unionByName(crowded.where(F.col("n") > params.region).select(dealt.alias("cell"), "id", "own", "region"))
    made = materialize(spark, out, "cells")
    for df in spent:
        discard(spark, df)
    return made


def in_runs(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of ``by`` of a sorted stream, of a bounded number of rows besides the last group."""
    parts: list[pa.RecordBatch] = []
    for b in batches:
        if b.num_rows:
            parts.append(b)
        if sum(p.num_rows for p in parts) < 4096 and sum(p.nbytes for p in parts) < 32_000_000:
            continue
        t = pa.Table.from_batches(parts)
        ends = group_ends(t, by)
        if len(ends) > 1:
            yield t.slice(0, ends[-2])
            t = t.slice(ends[-2])
        parts = t.combine_chunks().to_batches()
    if parts:
        yield pa.Table.from_batches(parts)


def group_ends(t: pa.Table, by: list[str]) -> np.ndarray:
    """Where each run of equal ``by`` ends."""
    change = np.zeros(max(0, t.num_rows - 1), bool)
    for c in by:
        x = t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        change |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(change) + 1, t.num_rows) if t.num_rows else np.zeros(0, np.int64)


def within(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of rows of the same run."""
    n = int(ends[-1]) if len(ends) else 0
    last = np.repeat(ends, np.diff(ends, prepend=0))
    count = last - np.arange(n) - 1
    i = np.repeat(np.arange(n), count)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def candidates(i: np.ndarray, j: np.ndarray, sketch: np.ndarray, size: np.ndarray, root: np.ndarray, params: NearDupParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs those of different components that may reach the threshold, with their number of equal minima."""
    x, y = size[i], size[j]
    keep = np.flatnonzero((root[i] != root[j]) & (100 * np.minimum(x, y) >= params.percent * np.maximum(x, y)))
    i, j = i[keep], j[keep]
    same = np.zeros(len(i), np.int64)
    for low in range(0, len(i), 50_000):
        at = slice(low, low + 50_000)
        same[at] = (sketch[i[at]] == sketch[j[at]]).sum(1)
    keep = same >= params.agree()
    return i[keep], j[keep], same[keep]


def prefixes(own: np.ndarray) -> np.ndarray:
    """The longest common prefix, in minima, of each row with the one after it."""
    return np.logical_and.accumulate(own[1:] == own[:-1], axis=1).sum(1)


def _stacked(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def asked(rows: DataFrame, params: NearDupParams) -> DataFrame:
    """(cell, id, own, root) of the classes that have a candidate of another component in a cell; ``rows``: these, sketch, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_runs(batches, ["cell"]):
            i, j = _candidates_of(t, params)
            yield from t.select(["cell", "id", "own", "root"]).take(pa.array(np.unique(np.concatenate([i, j])))).combine_chunks().to_batches()

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "cell long, id long, own binary, root long")


def asked_pairs(rows: DataFrame, params: NearDupParams) -> DataFrame:
    """As ``asked``, but of all cells that a pair of candidates shares each class goes only to the one of the lowest hash."""
    columns = ["id", "own", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_runs(batches, ["cell"]):
            i, j = map(pa.array, _candidates_of(t, params))
            sides = [t.column("cell").take(i), *(t.column(c).take(k) for k in (i, j) for c in columns)]
            yield from pa.Table.from_arrays(sides, names=["cell", *(f"{c}{k}" for k in "ab" for c in columns)]).combine_chunks().to_batches()

    schema = "cell long, " + ", ".join(f"id{k} long, own{k} binary, root{k} long" for k in "ab")
    pairs = rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)
    low, high = F.least("ida", "idb"), F.greatest("ida", "idb")
    sides = F.array(*[F.struct(F.col(f"id{k}").alias("id"), F.col(f"own{k}").alias("own"), F.col(f"root{k}").alias("root")) for k in "ab"])
    one = pairs.groupBy(low.alias("low"), high.alias("high")).agg(F.min(F.struct(F.xxhash64("cell").alias("h"), "cell", sides.alias("sides"))).alias("o"))
    return one.select("o.cell", F.explode("o.sides").alias("x")).select("cell", "x.id", "x.own", "x.root").distinct()


def _candidates_of(t: pa.Table, params: NearDupParams) -> tuple[np.ndarray, np.ndarray]:
    i, j = within(group_ends(t, ["cell"]))
    return candidates(i, j, _stacked(t.column("sketch"), "u1"), t.column("size").to_numpy(), t.column("root").to_numpy(), params)[:2]


def confirm(i: np.ndarray, j: np.ndarray, lcp: np.ndarray, same: np.ndarray, sets: list[np.ndarray], root: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Components by confirmed links among the candidate pairs, longest common prefix first, as links of each row with
    the first of its own; what is connected already is skipped."""
    order = np.lexsort((-same, -lcp))
    parent: dict[int, int] = {}

    def find(a: int) -> int:
        while (b := parent.get(a, a)) != a:
            parent[a] = parent.get(b, b)
            a = parent[a]
        return a

    first = np.unique(root, return_index=True)  # a row that stands for each component known so far
    stands = dict(zip(first[0].tolist(), first[1].tolist(), strict=True))
    for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
        a, b = find(int(root[x])), find(int(root[y]))
        if a == b:
            continue
        inter = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if 100 * inter >= percent * (len(sets[x]) + len(sets[y]) - inter):
            parent[max(a, b)] = min(a, b)
    return [(stands[find(a)], stands[a]) for a in parent if find(a) != a]


def cell_links(rows: DataFrame, by: list[str], params: NearDupParams) -> DataFrame:
    """Links (a, b) of each cell's components, a star each; ``rows``: the columns ``by``, id, own, sketch, root, set, and to_all: whether
    a class is to be compared with all others or only with those of which this is true."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in in_runs(batches, by):
            low, a, b = 0, [], []
            for high in group_ends(t, by):
                part = t.slice(low, high - low)
                low = high
                ids, everyone = part.column("id").to_numpy(), np.array(part.column("to_all").to_pylist(), dtype=bool)
                order = np.lexsort((~everyone, ids))  # a class that comes in both ways counts once
                at = np.sort(order[np.flatnonzero(np.diff(ids[order], prepend=-1))])  # in the order of the tree
                if len(at) < 2:
                    continue
                part, ids, everyone = part.take(pa.array(at)), ids[at], everyone[at]
                sets = [np.frombuffer(s, np.uint64) for s in part.column("set").to_pylist()]
                root, size = part.column("root").to_numpy(), np.array([len(s) for s in sets])
                i, j = within(np.array([len(at)]))
                keep = everyone[i] | everyone[j]
                i, j, same = candidates(i[keep], j[keep], _stacked(part.column("sketch"), "u1"), size, root, params)
                lcp = np.array([step[x:y].min() for x, y in zip(i, j, strict=True)]) if len(step := prefixes(_stacked(part.column("own"), ">u2"))) and len(i) else np.zeros(len(i), np.int64)
                for x, y in confirm(i, j, lcp, same, sets, root, params.percent):
                    a.append(ids[x])
                    b.append(ids[y])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.repartition(*by).sortWithinPartitions(*by, "own", "id").mapInArrow(run, "a long, b long")


# --- all of it --------------------------------------------------------------------------------------------------


def text_key(text: Column) -> Column:
    """The key of a text's word sequence, as ``shingles`` gives it: the MD5 of its words, A-Z folded, with spaces between."""
    spaced = F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), r"[\x20\x09-\x0D]+", " "))
    return F.when(spaced != "", F.unhex(F.md5(spaced)))


def few(ids: DataFrame, params: NearDupParams) -> DataFrame:
    """``ids`` (one number a row), to be broadcast if they take at most ``broadcast_mb``."""
    most = params.broadcast_mb * 1_000_000 // 64  # bytes a broadcast id takes, at most
    return F.broadcast(ids) if ids.limit(most + 1).count() <= most else ids


def shingle_sets(docs: DataFrame, wanted: DataFrame, params: NearDupParams) -> DataFrame:
    """(id, set) of the classes ``wanted`` (id, doc_id, key), one row a class; only the doc_ids are joined to the texts."""
    ids = few(wanted.select("doc_id").distinct(), params)
    texts = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(ids, "doc_id", "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # so that copies leave a task once
        for texts in chain.from_iterable(portions(b.column("text")) for b in batches):
            keys, sets = [], []
            for t in texts:
                s, k = shingles(t, params.words)
                if k is not None and k not in seen:
                    seen.add(k)
                    keys.append(k)
                    sets.append(s.tobytes())
            if len(seen) > 100_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "set"])

    return texts.mapInArrow(run, "key binary, set binary").join(wanted.select("key", "id"), "key").dropDuplicates(["key"]).select("id", "set")


def with_sketches(classes: DataFrame) -> DataFrame:
    """``sig`` to ``sketch``: the last byte of each minimum is enough to count equal ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.drop_columns(["sig"]).append_column("sketch", pa.array([s[1::2] for s in b.column("sig").to_pylist()], pa.binary()))

    return classes.select("id", "key", "doc_id", F.col("n_shingles").alias("size"), "sig").mapInArrow(run, "id long, key binary, doc_id long, size long, sketch binary")


def class_components(spark: SparkSession, docs: DataFrame, classes: DataFrame, params: NearDupParams) -> DataFrame:
    """(id, root) of the classes that are linked; root: a class that stands for the component (for which there may be no row)."""
    forest = cells(spark, classes, params)
    info = materialize(spark, with_sketches(classes.join(forest.select("id").distinct(), "id", "left_semi")), "info")
    sets = materialize(spark, shingle_sets(docs, info, params), "sets")
    looks = info.select("id", "sketch", "size")
    links, labels = [], None
    for sweep in range(3):
        placed = forest.withColumn("root", F.col("id"))
        if labels is not None:
            mixed = forest.join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
            kinds = mixed.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("cell")
            placed = mixed.join(kinds, "cell", "left_semi")
        placed = placed.join(looks, "id")
        if sweep < 2:  # one cell for each class: that of the lowest hash, so that classes of a group choose alike
            choice = F.struct(F.xxhash64("cell", F.lit(sweep)).alias("h"), "cell", "own", "root")
            open_ = asked(placed, params).groupBy("id").agg(F.min(choice).alias("o")).select("id", "o.cell", "o.own", "o.root")
        else:
            open_ = asked_pairs(placed, params)
        open_ = materialize(spark, open_, "open")
        wanted = few(open_.select("id").distinct(), params)  # so that only their sets move
        rows = open_.join(looks.select("id", "sketch"), "id").join(sets.join(wanted, "id", "left_semi"), "id").withColumn("to_all", F.lit(True))
        links.append(materialize(spark, cell_links(rows, ["cell"], params), "confirmed"))
        discard(spark, open_)
        star = links[-1].select(F.col("b").alias("id"), F.col("a").alias("root"))
        if sweep == 0:  # each class was in one cell only: its star is all of its component
            labels = star
        elif sweep == 1:
            labels = materialize(spark, merged(labels, star), "labels")
    more = region_links(spark, forest, looks, sets, labels, params)
    links += [] if more is None else [more]
    found = components(spark, reduce(DataFrame.unionByName, links))
    for df in (forest, info, sets, labels, *links):
        discard(spark, df)
    roots = found.select(F.col("node").alias("id"), "root")
    roots._quern_path = found._quern_path
    return roots


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, root) from two sets of stars (id, root) of at most a cell each, the second between members of the first's:
    classes with one root are connected. Two steps from star to star, not all of them; the rest is left to ``components``."""
    ids = first.select("id").unionByName(first.select(F.col("root").alias("id"))).unionByName(second.select("id")).unionByName(second.select(F.col("root").alias("id"))).distinct()
    both = ids.join(first.withColumnRenamed("root", "_a"), "id", "left").join(second.withColumnRenamed("root", "_b"), "id", "left")
    both = both.select("id", F.coalesce("_a", "id").alias("a"), F.coalesce("_b", "id").alias("b"))
    by_a = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("x"))
    near = both.join(by_a, "a")
    by_b = near.groupBy("b").agg(F.min("x").alias("y"))
    last = near.join(by_b, "b").groupBy("a").agg(F.min("y").alias("root"))
    return both.join(last, "a").select("id", "root")


def region_links(spark: SparkSession, forest: DataFrame, looks: DataFrame, sets: DataFrame, roots: DataFrame, params: NearDupParams) -> DataFrame | None:
    """Links within regions of several cells: what isn't in a region's largest component is compared with all of it."""
    if forest.where("region is not null").isEmpty():
        return None
    dealt = forest.where("region is not null").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    sizes = dealt.groupBy("region", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("region").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"))
    main = main.where("n > most").select("region", "main", F.ceil((F.col("n") - F.col("most")) / params.region).cast("int").alias("parts"), "n")
    main = materialize(spark, main, "open")
    if main.isEmpty():
        discard(spark, main)
        return None
    judged = materialize(spark, join_hot(dealt, main, "region", dealt.count()), "judged")
    open_ = judged.where("root <> main").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int"))
    spots = judged.select("region", "cell").distinct()
    # a part of the open ones meets every cell: once per cell for them, once per part for all others
    ask = open_.select("region", "part", "id", "own", "root").join(spots, "region").withColumn("to_all", F.lit(True))
    against = judged.select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "own", "root", "cell", F.lit(False).alias("to_all"))
    wanted = few(judged.select("id").distinct(), params)
    rows = ask.unionByName(against).join(looks.select("id", "sketch"), "id").join(sets.join(wanted, "id", "left_semi"), "id")
    found = materialize(spark, cell_links(rows, ["region", "part", "cell"], params), "confirmed")
    for df in (main, judged):
        discard(spark, df)
    return found


def grouped(spark: SparkSession, docs: DataFrame, params: NearDupParams) -> DataFrame:
    """doc_id, n_shingles, key, component_id, lead of every row; lead: the key of the first text of the component."""
    with batch_rows(spark, params.batch):
        rows = materialize(spark, signed(docs, params), "signed")
        known = rows.where("key is not null and doc_id is not null")
        classes = known.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("sig").alias("sig"), F.min("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
        classes = materialize(spark, classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # written, so the ids stay
        roots = class_components(spark, docs, classes, params)
    own = classes.select("id", "key", "doc_id", "n").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    own = materialize(spark, own, "roots")
    discard(spark, roots)
    first = own.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("first"), F.count("*").alias("classes")).where("classes > 1")
    first = materialize(spark, first.select("root", F.col("first.doc_id").alias("component"), F.col("first.key").alias("lead"), "classes"), "first")
    alone = own.join(first.select("root"), "root", "left_anti").select("key", F.col("doc_id").alias("component"), F.col("key").alias("lead"), "n")
    linked = join_hot(own, first, "root", own.count(), "classes").select("key", "component", "lead", "n")
    judged = materialize(spark, linked.unionByName(alone), "judged")
    for df in (classes, own, first):
        discard(spark, df)
    slim = rows.select("doc_id", "n_shingles", "key")
    have = join_hot(slim.where("key is not null"), judged, "key", rows.count(), how="left")
    none = slim.where("key is null").select("*", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("lead"))
    return have.select("doc_id", "n_shingles", "key", F.coalesce("component", "doc_id").alias("component_id"), "lead").unionByName(none)


def duplicate_groups(spark: SparkSession, docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text)."""
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return grouped(spark, docs, params).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_first(spark: SparkSession, docs: DataFrame, params: NearDupParams = NearDupParams()) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they were: of each group one text, that of its smallest doc_id.

    Rows go by doc_id and text together: of rows that repeat a doc_id with different texts each is judged by its own.
    Rows that repeat both are one document and stay or go together; a row without doc_id goes if one with has its text.
    """
    name = lambda doc_id, key: F.concat_ws(":", doc_id.cast("string"), F.hex(key))
    leads = (F.col("doc_id") == F.col("component_id")) & (F.col("key") == F.col("lead"))
    gone = grouped(spark, docs, params).where(F.col("lead").isNotNull() & ~F.coalesce(leads, F.lit(False)))
    gone = materialize(spark, gone.groupBy("doc_id", name(F.col("doc_id"), F.col("key")).alias("_name")).agg(F.count("*").alias("_n")), "gone")
    # only rows whose doc_id is on the list, or that have none, need their key and move; the others stay where they are
    ids = few(gone.where("doc_id is not null").select(F.col("doc_id").alias("_id")).distinct(), params)
    listed = F.col("doc_id").cast("long") == F.col("_id")
    clear = docs.where("doc_id is not null").join(ids, listed, "left_anti")
    doubtful = docs.join(ids, listed, "left_semi").unionByName(docs.where("doc_id is null"))
    named = doubtful.withColumn("_name", name(F.col("doc_id").cast("long"), text_key(F.col("text"))))
    most = max(64, (gone.agg(F.sum("_n")).first()[0] or 0) // 10_000)  # as in join_hot: at most 10 000 hot names are broadcast
    hot, cold = gone.where(F.col("_n") > most).select("_name"), gone.where(F.col("_n") <= most).select("_name")
    return clear.unionByName(named.join(F.broadcast(hot), "_name", "left_anti").join(cold, "_name", "left_anti").select(*docs.columns))
