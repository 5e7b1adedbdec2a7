"""Best-fit packing of tokenised documents into sequences, by linear grouping.

Every document is tokenised once; a long one is cut into full pieces, only its first piece may be shorter. What is
packed is the histogram of piece lengths: at most ``capacity`` numbers, whatever the corpus, so the plan is made on
the driver. Lengths above ``small`` are put into groups of equal numbers of pieces and rounded up to the group's
largest; a linear programme over configurations of the few rounded sizes (column generation, knapsack pricing) is
solved and rounded down. Real lengths take the configurations' places, largest first; the rest and the small pieces
then go best-fit. The plan is a table of runs (length, first rank, sequence, offset): its size depends on the
capacity alone. Pieces get ranks within their length from per-partition counts, so that no length meets in one
task, and are looked up in the plan.

Edge cases: a null or empty text is one piece of the end token alone; repeated rows are packed as often as they
occur; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions.batches import portions
from quernstone.llm.common import batch_rows, materialize


@dataclass(frozen=True)
class PackParams:
    tokenizer: str  # path of a tokenizers JSON file
    capacity: int = 1024
    end_id: int = 2
    small: int = 420  # shorter pieces go best-fit only
    groups: int = 72  # rounded sizes
    batch: int = 1024  # texts of an Arrow batch


# --- tokens -----------------------------------------------------------------------------------------------------

_CODERS: dict[str, "Coder"] = {}


def _chunk_encoder(path: str):
    """A faster encoder of short chunks with the same ids, where the file is a byte-level BPE whose ids are its ranks."""
    import tiktoken

    model = json.loads(open(path, encoding="utf-8").read())
    pre, vocab = model.get("pre_tokenizer") or {}, model["model"].get("vocab")
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not isinstance(vocab, dict) or model.get("normalizer"):
        return None
    # the byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    added = {t["content"] for t in model.get("added_tokens", [])}
    ranks = {bytes(letter[c] for c in w): i for w, i in vocab.items() if w not in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["model"]["merges"]]
    if any(vocab[a + b] != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    words = r"""'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    code = tiktoken.Encoding("chunks", pat_str=words, mergeable_ranks=ranks, special_tokens={})
    return lambda c: np.array(code.encode_ordinary(c), "<u4").tobytes()


class Coder:
    """Token ids of texts as little-endian bytes.

    Chunks between single spaces are tokenised alone and remembered: the byte-level pattern never joins across a
    space that a visible character follows. Texts where that does not hold, or that may hold a special token, are
    tokenised whole.
    """

    LIMIT = 400_000  # remembered chunks, to bound memory

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.chunk = _chunk_encoder(path) or (lambda c: self._ids([c])[0])

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        if "  " in text or any(s in text for s in self.special):
            return self._ids([text])[0]
        head, *rest = text.split(" ")
        if any(c[-1:].isspace() for c in (head, *rest[:-1])) or not all(rest):
            return self._ids([text])[0]
        chunks = [head, *[" " + c for c in rest]] if head else [" " + c for c in rest]
        known = self.known
        if missing := {c for c in chunks if c not in known}:
            if len(known) + len(missing) > self.LIMIT:
                known.clear()
                missing = set(chunks)
            for c in missing:
                known[c] = self.chunk(c)
        return b"".join(map(known.__getitem__, chunks))


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def cut(ids: bytes, capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece may be shorter."""
    n, at, out = len(ids) // 4, 0, []
    first = n if n <= capacity else n % capacity or capacity
    while at < n:
        size = capacity if at else first
        out.append((len(out), at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
        at += size
    return out


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, params: PackParams) -> DataFrame:
    """Every piece with the number of its task and its place among the task's pieces of that length."""
    end = np.array([params.end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part = coder(params.tokenizer), TaskContext.get().partitionId()
        seen = [0] * (params.capacity + 1)
        made = pa.schema([(c, pa.int32() if c in ("piece", "part") else pa.int64()) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")])
        for b in batches:
            for ids, texts in zip(portions(b.column("doc_id")), portions(b.column("text")), strict=True):
                rows = []
                for i, t in zip(ids, texts, strict=True):
                    for p in cut((code.encode(t) if t else b"") + end, params.capacity):
                        rows.append((i, *p, part, seen[p[2]]))
                        seen[p[2]] += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), made, strict=True)], schema=made)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", part int, nth long")


# --- the plan ---------------------------------------------------------------------------------------------------


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, number of each size): the rounded-down optimum of the configuration programme.

    Column generation: the basis starts with one size per configuration; each step prices all configurations at the
    dual values by an unbounded knapsack and pivots the best one in, until none is worth more than a sequence.
    """
    m = len(sizes)
    cols = [np.eye(m)[i] * (capacity // sizes[i]) for i in range(m)]
    basis = np.stack(cols, 1)
    inv, need = np.linalg.inv(basis), np.array(demand, float)
    x = inv @ need
    for _ in range(60 * m):
        dual = inv.sum(0)  # each configuration costs 1
        best = np.zeros(capacity + 1)
        took = np.full(capacity + 1, -1)
        order = [i for i in np.argsort(-dual / np.array(sizes)) if dual[i] > 0]
        for c in range(1, capacity + 1):
            best[c] = best[c - 1]
            fits = [(best[c - sizes[i]] + dual[i], i) for i in order if sizes[i] <= c]
            if fits and (top := max(fits))[0] > best[c] + 1e-12:
                best[c], took[c] = top
        if best[capacity] <= 1 + 1e-7:
            break
        new, c = np.zeros(m), capacity
        while c > 0:
            if took[c] < 0:
                c -= 1
            else:
                new[took[c]] += 1
                c -= sizes[took[c]]
        step = inv @ new
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, step, 1), np.inf)
        out = int(ratio.argmin())
        basis[:, out] = new
        inv = np.linalg.inv(basis)
        x = np.maximum(inv @ need, 0)
    return [(int(t + 1e-6), tuple(map(int, basis[:, j]))) for j, t in enumerate(x) if t >= 1 - 1e-6]


Bins = list[tuple[int, tuple[int, ...]]]


def plan_bins(counts: dict[int, int], params: PackParams) -> Bins:
    """(times, lengths in a sequence) for a histogram of lengths; uses every piece exactly once."""
    cap = params.capacity
    bins: Bins = [(n, (s,)) for s, n in counts.items() if s >= cap and n]
    left = {s: n for s, n in counts.items() if params.small <= s < cap and n}
    large = sorted(left, reverse=True)
    total = sum(left.values())
    groups: list[list[int]] = [[]]
    seen = 0
    for s in large:  # equal numbers of pieces; a length stays whole
        if groups[-1] and seen >= len(groups) * total / params.groups:
            groups.append([])
        groups[-1].append(s)
        seen += left[s]
    opened: Bins = []
    if large:
        sizes, demand = [g[0] for g in groups], [sum(left[s] for s in g) for g in groups]
        for times, config in configurations(sizes, demand, cap):
            places = [g for g, n in enumerate(config) for _ in range(n)]
            while times > 0 and places:
                # the largest piece left of each place's group; a run lasts until one of them is used up
                chosen: list[int] = []
                use: dict[int, int] = {}
                for g in places:
                    s = next((s for s in groups[g] if left[s] - use.get(s, 0) > 0), None)
                    if s is not None:
                        use[s] = use.get(s, 0) + 1
                        chosen.append(s)
                if not chosen:
                    break
                run = min(times, *(left[s] // n for s, n in use.items()))
                for s, n in use.items():
                    left[s] -= run * n
                opened.append((run, tuple(chosen)))
                times -= run
    rest = {s: n for s, n in left.items() if n} | {s: n for s, n in counts.items() if s < params.small and n}
    return bins + best_fit(opened, rest, cap)


def best_fit(opened: Bins, rest: dict[int, int], cap: int) -> Bins:
    """Best-fit decreasing of the rest into what is open, whole runs at a time."""
    by_gap: dict[int, Bins] = {}
    for n, lengths in opened:
        by_gap.setdefault(cap - sum(lengths), []).append((n, lengths))
    for s in sorted(rest, reverse=True):
        n = rest[s]
        while n:
            gap = next((g for g in range(s, cap) if by_gap.get(g)), None)
            if gap is None:
                times, lengths, gap = (n // (cap // s), (), cap) if n >= cap // s else (1, (), cap)
                fill = min(cap // s, n)
            else:
                times, lengths = by_gap[gap].pop()
                fill = min(gap // s, n)
                if times * fill > n:
                    keep = n // fill
                    by_gap[gap].append((times - keep, lengths))
                    times = keep
            by_gap.setdefault(gap - fill * s, []).append((times, lengths + (s,) * fill))
            n -= times * fill
    return [b for runs in by_gap.values() for b in runs]


def plan_runs(bins: Bins) -> dict[int, np.ndarray]:
    """length -> rows (first rank, number, first sequence, offset), by rank."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, lengths in bins:
        at = 0
        for s in lengths:
            rank = used.get(s, 0)
            runs.setdefault(s, []).append((rank, times, sequence, at))
            used[s] = rank + times
            at += s
        sequence += times
    return {s: np.array(r, dtype=np.int64) for s, r in runs.items()}


# --- putting it together ----------------------------------------------------------------------------------------


def pack(spark: SparkSession, docs: DataFrame, params: PackParams) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs`` (doc_id, text)."""
    # written once: a piece's place among its task's pieces must not change when a task runs again
    with batch_rows(spark, params.batch):
        cutted = materialize(spark, pieces(docs, params), "pieces")
    parts = cutted.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {int(r.length): int(r.n) for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = plan_runs(plan_bins(counts, params))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = parts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, off = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        order = np.argsort(length.to_numpy(), kind="stable")
        cuts = np.flatnonzero(np.diff(length.to_numpy()[order])) + 1
        for rows in np.split(order, cuts) if len(order) else ():
            r, k = runs[int(length.iloc[rows[0]])], rank.to_numpy()[rows]
            at = np.searchsorted(r[:, 0], k, "right") - 1
            seq[rows], off[rows] = r[at, 2] + k - r[at, 0], r[at, 3]
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    ranked = cutted.join(first, ["part", "length"]).withColumn("at", place("length", F.col("first") + F.col("nth")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
