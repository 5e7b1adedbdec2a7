"""Ranked lexical search by Fagin's threshold algorithm, exact in 64-bit integers.

One pass over the documents makes a forward index: of each document its length and the frequencies of the asked terms. From
it come the statistics (all documents), and from each stretch of it (bounded in postings) the lists of the asked terms sorted by
impact. A query reads its lists round-robin; each document that turns up is scored whole by look-ups in the forward index; it
stops when the threshold, the sum of the impacts where its lists stand, is strictly below the k-th score, so that documents
of equal score are all seen. A task carries the k best from stretch to stretch, so later ones stop sooner. Tasks return
at most k rows an item; those are merged by item in two steps. Nothing is shuffled by term, so frequent terms make no hot task.

Items are taken in blocks of at most ``block_terms`` terms, each a further pass; so what a task gets is bounded whatever their number.

Null and empty texts have no terms: such documents count nowhere, such items return nothing. Documents without doc_id count in the
statistics and are not returned. Repeated documents are documents of their own; items that repeat item_id and text are one.
Equal scores go by doc_id, whole repeats in any order. Empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.common import materialize

RESULT = "item int, doc_id long, score long"
INDEX = "doc_id long, n long, terms array<int>, tfs array<int>"
#: Bytes to bytes: A-Z in lower case, ASCII but digits and letters to a space; bytes of other characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


@dataclass(frozen=True)
class SearchParams:
    """``k`` documents an item; a stretch has about ``stretch`` postings, a block of items about ``block_terms`` terms; lists are read ``step`` entries at a time."""

    k: int = 20
    stretch: int = 1_000_000
    block_terms: int = 2_000_000
    step: int = 16


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _forward(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, sizes, terms, tfs = [], [0], [], []
            for raw in b.column(1).cast(pa.binary()):
                words = terms_of(raw.as_py())
                counts = Counter(words)
                found = sorted((vocabulary[w], counts[w]) for w in counts.keys() & vocabulary.keys())
                n.append(len(words))
                sizes.append(sizes[-1] + len(found))
                terms += [t for t, _ in found]
                tfs += [c for _, c in found]
            at = pa.array(sizes, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tfs, pa.int32()))],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return run


def _document_frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(size, np.int64), 0, 0
        for b in batches:
            df += np.bincount(b.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=size)
            n = b.column("n").to_numpy(zero_copy_only=False)
            docs, length = docs + int((n > 0).sum()), length + int(n.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *some.tolist()], pa.int32()), pa.array([docs, length, *df[some].tolist()], pa.int64())], names=["term", "n"])

    return run


@dataclass(frozen=True)
class Stretch:
    """Some documents: postings sorted by term and falling impact, and the forward index as sorted keys document * width + term."""

    doc_ids: np.ndarray
    starts: np.ndarray
    docs: np.ndarray
    impacts: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    width: int

    @staticmethod
    def of(doc_ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, total: int, length: int) -> Stretch:
        doc = np.repeat(np.arange(len(doc_ids)), sizes)
        m = (75 + (25 * n * total) // max(length, 1))[doc]
        tf = tfs.astype(np.int64)
        impact = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m))
        order = np.lexsort((doc, -impact, terms))
        width = len(weights)
        return Stretch(doc_ids, np.searchsorted(terms[order], np.arange(width + 1)), doc[order], impact[order], doc * width + terms, impact, width)

    def look_up(self, docs: np.ndarray, terms: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of ``docs`` by the forward index."""
        wanted = docs[:, None] * self.width + terms[None, :]
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], 0) @ times

    def search(self, terms: np.ndarray, times: np.ndarray, best: list[tuple[int, int]], k: int, step: int) -> list[tuple[int, int]]:
        """The k best (-score, doc_id) of ``best`` and this stretch."""
        here = self.starts[terms + 1] > self.starts[terms]
        terms, times = terms[here], times[here]
        if not len(terms):
            return best
        at, end = self.starts[terms].copy(), self.starts[terms + 1]
        seen = np.zeros(len(self.doc_ids), bool)
        while True:
            # the bound of what is unread, list by list; a list that is read to its end holds nothing more
            threshold = int((np.where(at < end, self.impacts[np.minimum(at, end - 1)], 0) * times).sum())
            if threshold <= 0 or len(best) == k and threshold < -best[-1][0]:
                return best
            upto = np.minimum(at + step, end)
            new = np.unique(np.concatenate([self.docs[a:b] for a, b in zip(at, upto, strict=True)]))
            new = new[~seen[new]]
            seen[new] = True
            at = upto
            step = min(2 * step, 4096)
            if len(new):
                scores = self.look_up(new, terms, times)
                least = -best[-1][0] if len(best) == k else 1
                good = scores >= max(least, 1)
                best = sorted(best + list(zip((-scores[good]).tolist(), self.doc_ids[new[good]].tolist(), strict=True)))[:k]


def _search(items, weights, total: int, length: int, p: SearchParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, w = items.value, weights.value
        best: list[list[tuple[int, int]]] = [[] for _ in asked]

        def stretches() -> Iterator[list[pa.RecordBatch]]:
            held, size = [], 0
            for b in batches:
                b = b.filter(b.column("doc_id").is_valid())
                ends = np.cumsum(np.diff(b.column("terms").offsets.to_numpy()))
                start = 0
                while start < b.num_rows:  # a batch of long documents is cut too
                    base = ends[start - 1] if start else 0
                    upto = max(start + 1, int(np.searchsorted(ends, base + max(1, p.stretch - size), "right")))
                    held.append(b.slice(start, upto - start))
                    size += int(ends[upto - 1] - base)
                    start = upto
                    if size >= p.stretch or start < b.num_rows:
                        yield held
                        held, size = [], 0
            if held:
                yield held

        for part in stretches():
            t = pa.Table.from_batches(part).combine_chunks()
            if not t.num_rows:
                continue
            terms = t.column("terms").combine_chunks()
            flat = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(flat):
                continue
            sizes = np.diff(terms.offsets.to_numpy())
            s = Stretch.of(t.column("doc_id").to_numpy(), t.column("n").to_numpy(), sizes, flat, t.column("tfs").combine_chunks().flatten().to_numpy(zero_copy_only=False), w, total, length)
            for i, (_, ids, times) in enumerate(asked):
                best[i] = s.search(ids, times, best[i], p.k, p.step)
        rows = [(i, d, -s) for i, found in enumerate(best) for s, d in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["item", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, p: SearchParams) -> Iterator[list[tuple[int | None, Counter]]]:
    """The items with their counted terms, in blocks; the driver holds one block at a time."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct().sort("item_id", "text").toLocalIterator():
        counts = Counter(terms_of(None if r.text is None else r.text.encode("utf-8", "surrogatepass")))
        block.append((r.item_id, counts))
        size += len(counts)
        if size >= p.block_terms:
            yield block
            block, size = [], 0
    if block:
        yield block


def _top(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_documents(spark: SparkSession, docs: DataFrame, items: DataFrame, p: SearchParams = SearchParams()) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of each item (fewer, if fewer score above 0)."""
    found = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in _blocks(items, p):
        vocabulary = {w: i for i, w in enumerate(sorted({w for _, counts in block for w in counts}))}
        if not vocabulary:
            continue
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        index = materialize(spark, texts.mapInArrow(_forward(vocabulary), INDEX), "forward")
        counted = {r.term: r.n for r in index.mapInArrow(_document_frequencies(len(vocabulary)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        total, length = counted.get(-2, 0), counted.get(-1, 0)
        weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * counted.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
        asked = [(item, np.array([vocabulary[w] for w in counts], np.int64), np.array(list(counts.values()), np.int64)) for item, counts in block]
        sc = spark.sparkContext
        rows = index.mapInArrow(_search(sc.broadcast(asked), sc.broadcast(weights), total, length, p), RESULT)
        # k rows a task and item: first the best of some tasks each, then of all
        rows = _top(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(16))), ["item", "part"], p.k).drop("rank", "part")
        named = spark.createDataFrame([(i, item) for i, (item, *_) in enumerate(asked)], "item int, item_id long")
        found = found.unionByName(_top(rows, ["item"], p.k).join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    return found
