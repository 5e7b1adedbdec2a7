"""Benchmark decontamination by BM25 retrieval of test items, with block-max WAND.

The items are indexed: postings by term in item order, cut into blocks of neighbouring items that know each term's
largest impact. Impacts are BM25 scores divided by the item's score for itself, so that one threshold fits all items.
Term statistics (how many items have a term, mean and greatest length) are those of all items, counted in Spark.

Every training text is cut into overlapping passages, each of them a query; block-max WAND answers many passages at
once. Shallow pass: the block maxima of a passage's terms bound what any item of a block can score; the commonest terms,
whose bounds together stay below a share of the threshold, count with that share. Only blocks whose bound reaches the
threshold are opened. Deep pass: the postings of opened blocks, those of the common terms included, are added up. Every
item at the threshold or above is retrieved, none else. A retrieved item counts as found in the text only if enough
word n-grams of its question and of its answer are in the passage.

The index is dealt into shards bounded in items and in bytes, each built by a task from its own items and broadcast.
A pass over the texts has at most ``resident`` shards; so texts are read once, or once for each so many shards of a very
large benchmark. Results do not depend on the number of shards. Nothing else moves: texts are neither shuffled nor
collected.

An item's text has no marked parts: its last sentence counts as the answer, the sentences before it as the question
(an item of one sentence is split in the middle).

Edge cases: null or empty texts and items match nothing; items shorter than the n-gram are compared as a whole; texts
shorter than an item are one passage; items that repeat an id are each searched for, and a text reports an id once;
repeated texts are each reported; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.batches import by_portions
from quernstone.llm.common import discard, materialize


@dataclass(frozen=True)
class LeakParams:
    k1: float = 1.2
    b: float = 0.75
    threshold: float = 0.5  # share of an item's score for itself
    ngram: int = 3
    question: float = 0.6  # share of the part's n-grams that must be in the passage
    answer: float = 0.6
    common: float = 0.15  # share of the threshold that the bounds of the commonest terms may add up to
    block: int = 8  # items a block
    shard: int = 20_000  # items an index holds
    shard_mb: int = 32  # text that an index is made of
    resident: int = 4  # indexes a pass over the texts has


WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Lower-cased chunks between white space without what is neither letter nor digit."""
    return [w for t in text.lower().split() if (w := t if t.isalnum() else "".join(WORD.findall(t)))]


def parts(text: str) -> tuple[list[str], list[str]]:
    """Question and answer words of an item."""
    sentences = [w for s in re.split(r"(?<=[.!?])\s+|\n", text) if (w := words(s))]
    if len(sentences) > 1:
        return [w for s in sentences[:-1] for w in s], sentences[-1]
    whole = sentences[0] if sentences else []
    return whole[: (len(whole) + 1) // 2], whole[(len(whole) + 1) // 2 :]


def ngrams(tokens: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))} if tokens else set()


@dataclass(frozen=True)
class Statistics:
    """Of all items of the benchmark."""

    items: int
    words: int
    longest: int


class Index:
    """BM25 index of items; impacts are shares of an item's score for itself. ``df``: in how many of all items a term is."""

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], every: Statistics, params: LeakParams) -> None:
        self.params, self.longest = params, every.longest
        items = [(i, w, t) for i, t in sorted(items) if (w := words(t))]
        self.ids = [i for i, _, _ in items]
        self.parts = [tuple(ngrams(x, params.ngram) for x in parts(t)) for _, _, t in items]
        mean = every.words / max(1, every.items)
        rows: list[tuple[str, int, float]] = []
        for d, (_, w, _) in enumerate(items):
            norm = params.k1 * (1 - params.b + params.b * len(w) / mean)
            own = {t: math.log(1 + (every.items - df[t] + 0.5) / (df[t] + 0.5)) * f * (params.k1 + 1) / (f + norm) for t, f in Counter(w).items()}
            whole = sum(own.values())
            rows += [(t, d, s / whole) for t, s in own.items()]
        rows.sort(key=lambda r: r[:2])
        self.terms = {t: i for i, t in enumerate(dict.fromkeys(r[0] for r in rows))}
        term = np.array([self.terms[r[0]] for r in rows], dtype=np.int64)
        self.item, self.impact = np.array([r[1] for r in rows], dtype=np.int64), np.array([r[2] for r in rows])
        # blocks of postings: of one term, in one run of items
        start = np.flatnonzero(np.diff(term * (len(items) + 1) + self.item // params.block, prepend=-1))
        self.start, self.end = start, np.append(start[1:], len(rows))
        self.block = self.item[start] // params.block
        self.top = np.maximum.reduceat(self.impact, start) if len(rows) else np.zeros(0)
        self.first = np.searchsorted(term[start], np.arange(len(self.terms) + 1))
        self.blocks = -(-len(items) // params.block)
        tops = np.maximum.reduceat(self.top, self.first[:-1]) if len(rows) else np.zeros(0)
        order = np.argsort(tops, kind="stable")
        common = order[np.cumsum(tops[order]) < params.threshold * params.common]
        self.common = np.zeros(len(self.terms), bool)
        self.common[common] = True
        self.rest = float(tops[common].sum())
        self.seen = Terms(self.terms)

    def search(self, owner: np.ndarray, term: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) of all items whose impacts add up to the threshold; ``owner``, ``term``: the passages' distinct terms."""
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        batch = max(1, 500_000 // max(1, self.blocks))  # bounds held at once
        for low in range(0, passages, batch):
            a, b = np.searchsorted(owner, [low, low + batch])
            out.append(self._batch(owner[a:b] - low, term[a:b], min(batch, passages - low)))
            out[-1] = (out[-1][0] + low, out[-1][1])
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def _batch(self, owner: np.ndarray, term: np.ndarray, passages: int) -> tuple[np.ndarray, np.ndarray]:
        least = self.params.threshold - 1e-9
        rare = ~self.common[term]
        own, at = self._blocks_of(owner[rare], term[rare])
        bound = np.bincount(own * self.blocks + self.block[at], self.top[at], passages * self.blocks)
        open_ = bound + self.rest >= least  # the pivots
        hit = open_.reshape(passages, -1).any(1)
        more = ~rare & hit[owner]
        own2, at2 = self._blocks_of(owner[more], term[more])
        own, at = np.concatenate([own, own2]), np.concatenate([at, at2])
        keep = open_[own * self.blocks + self.block[at]]
        own, at = own[keep], at[keep]
        count = self.end[at] - self.start[at]
        post = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.start[at], count)
        key, back = np.unique(np.repeat(own, count) * len(self.ids) + self.item[post], return_inverse=True)
        key = key[np.bincount(back, self.impact[post], len(key)) >= least]
        return key // len(self.ids), key % len(self.ids)

    def _blocks_of(self, owner: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The posting blocks of the terms, with the passage that asks for each."""
        count = self.first[term + 1] - self.first[term]
        return np.repeat(owner, count), np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[term], count)

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, float, float]]]:
        """For each text, (item id, question overlap, answer overlap) of the items found in it."""
        out: list[list[tuple[int, float, float]]] = [[] for _ in texts]
        if not self.ids:
            return out
        # passages of twice the longest item, each starting half a passage after the last: any stretch as long as an item lies in one
        step = self.longest
        seen, low = self.seen, 0
        while low < len(texts):
            high, size, all_terms, starts, ends, owner, chunked = low, 0, [], [], [], [], {}
            while high < len(texts) and size < 100_000:
                chunks = (texts[high] or "").lower().split()
                seen.bound()
                terms = np.fromiter(map(seen.__getitem__, chunks), np.int64, len(chunks))
                real = np.flatnonzero(terms > -2)
                s = np.arange(0, max(1, len(real) - step), step)
                all_terms.append(terms[real])
                starts.append(size + s)
                ends.append(size + np.minimum(s + 2 * step, len(real)))
                owner.append(np.full(len(s), high))
                chunked[high] = (size, chunks, real)
                size += len(real)
                high += 1
            terms, starts, ends, owner = map(np.concatenate, (all_terms, starts, ends, owner))
            sizes = ends - starts
            mine = np.repeat(np.arange(len(starts)), sizes)
            t = terms[np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)]
            once = np.unique((mine * len(self.terms) + t)[t >= 0])
            passage, item = self.search(once // len(self.terms), once % len(self.terms), len(starts))
            ends_at = np.append(np.flatnonzero(np.diff(passage)) + 1, len(passage))
            at_hit = 0
            for stop in ends_at if len(passage) else ():
                p = passage[at_hit]
                at, chunks, real = chunked[owner[p]]
                self._verify(item[at_hit:stop].tolist(), words(" ".join(chunks[i] for i in real[starts[p] - at : ends[p] - at])), out[owner[p]])
                at_hit = stop
            low = high
        return [sorted({i: (i, q, a) for i, q, a in sorted(found)}.values()) for found in out]

    def _verify(self, hits: list[int], own: list[str], found: list) -> None:
        for d in hits:
            q, a = (len(p & ngrams(own, len(next(iter(p))))) / len(p) if p else 1.0 for p in self.parts[d])
            if q >= self.params.question and a >= self.params.answer:
                found.append((self.ids[d], q, a))


class Terms(dict):
    """Chunk -> number of its term, -1 for a word that no item has, -2 for no word; remembers a bounded number."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.terms = terms

    def __missing__(self, chunk: str) -> int:
        w = words(chunk)
        found = self[chunk] = self.terms.get(w[0], -1) if w else -2
        return found

    def bound(self) -> None:
        if len(self) > 100_000:
            self.clear()

    def __reduce__(self):
        return Terms, (self.terms,)


def shards(spark: SparkSession, items: DataFrame, params: LeakParams) -> Iterator[list]:
    """Broadcast indexes of all items, in lists of at most ``resident``."""
    own = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    count, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, math.ceil(count / params.shard), math.ceil(size / (params.shard_mb * 1_000_000)))
    own = own.withColumn("shard", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)))

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [words(t) for t in b["text"]]
            rows = [(s, t, len(w) if i == 0 else 0) for s, w in zip(b["shard"], made, strict=True) for i, t in enumerate(sorted(set(w)))]
            yield pd.DataFrame(rows, columns=["shard", "term", "length"])

    # a row for each item and term; the first of an item has its length
    terms = materialize(spark, own.select("shard", "text").mapInPandas(tokens, "shard long, term string, length long"), "terms")
    lengths = terms.where("length > 0").agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max("length"), F.lit(1))).first()
    every = Statistics(*map(int, lengths))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    each = terms.select("shard", "term").distinct().join(df, "term")

    def build(shard: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        if not len(shard):
            return pd.DataFrame({"shard": [], "index": []})
        index = Index(list(zip(shard["item_id"].tolist(), shard["text"], strict=True)), dict(zip(known["term"], known["df"], strict=True)), every, params)
        return pd.DataFrame({"shard": [int(shard["shard"].iloc[0])], "index": [pickle.dumps(index)]})

    built = own.groupBy("shard").cogroup(each.groupBy("shard")).applyInPandas(build, "shard long, index binary")
    built = materialize(spark, built, "indexes")
    discard(spark, terms)
    for low in range(0, n, params.resident):
        part = built.where(F.col("shard").between(low, low + params.resident - 1)).select("index")
        found = [spark.sparkContext.broadcast(bytes(r["index"])) for r in part.toLocalIterator()]
        if found:
            yield found


class Loaded:
    """The indexes of a pass, unpacked once in each worker."""

    def __init__(self, shared: list) -> None:
        self.shared, self.indexes = shared, None

    def leaks(self, texts: list[str | None]) -> list[list[tuple[int, float, float]]]:
        if self.indexes is None:
            self.indexes = [pickle.loads(b.value) for b in self.shared]
        found = [index.leaks(texts) for index in self.indexes]
        return [sorted({x[0]: x for f in each for x in f}.values()) for each in zip(*found, strict=True)]

    def __reduce__(self):
        return Loaded, (self.shared,)


def find_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """doc_id, item_id, question_overlap, answer_overlap of every item found in a text of ``docs`` (doc_id, text)."""
    schema = "doc_id long, item_id long, question_overlap double, answer_overlap double"
    out = None
    for shared in shards(spark, items, params):
        loaded = Loaded(shared)

        def run(batches: Iterator[pd.DataFrame], loaded=loaded) -> Iterator[pd.DataFrame]:
            for b in batches:
                rows = [(None if pd.isna(i) else int(i), *x) for i, found in zip(b["doc_id"], loaded.leaks(list(b["text"])), strict=True) for x in found]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "question_overlap", "answer_overlap"]).astype({"doc_id": "Int64", "item_id": "int64", "question_overlap": float, "answer_overlap": float})

        found = docs.select("doc_id", "text").mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(spark: SparkSession, docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:
    """The rows of ``docs`` in which no item is found, all columns as they were."""
    for shared in shards(spark, items, params):
        docs = docs.where(_clean(Loaded(shared))("text"))
    return docs


def _clean(loaded: Loaded):
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from by_portions(lambda texts: [not x for x in loaded.leaks(texts)], pa.bool_())(batches)

    return F.arrow_udf(run, "boolean")
