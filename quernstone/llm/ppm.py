"""Language-model scores: prediction by partial matching over bytes, and a unigram word base.

The trie of byte contexts (the five bytes before, then four, and so on to none) is counted over all training texts,
each task adding up its own n-grams before the shuffle. All 256 byte values are kept, and the counts grow with the
corpus, so they stay a table. The escape of a context is estimated by method D; symbols that a context has seen are
excluded from the shorter contexts' distributions below it. A text's score is the sum of log10 probabilities of its
bytes (A-Z folded), the end included, under this pretrained trie.

A fixed number of the most frequent n-grams, with their probabilities, is given to each task, which settles most
bytes in place. The other n-grams of the texts are settled once each, beside the training n-grams that end in the
same three context bytes (all longer contexts that they can escape through are there), and come back by a join.
Contexts of at most two bytes have at most 256^3 nodes whatever the corpus, and go to each task.

The word base needs the count of every distinct training word, which grows with the corpus: the counts stay a
table. A fixed number of the most frequent words is given to each task, which settles most tokens in place; the
other words of each text go through a join.

Edge cases: a null or empty text is the end token alone; rows with a null doc_id count as training rows and are
scored; repeated rows are each counted and scored; further columns are ignored; with no training rows the base is
log10(1) per token and the trie is uniform; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions.batches import portions
from quernstone.llm.common import join_hot, materialize, most_frequent

ORDER = 5  # context bytes; an n-gram is these and the byte after them, in one number
ROWS = 256  # texts that scoring takes from a batch at once
PAD = b"\n" * ORDER  # a text begins as if after empty lines; 0xFF, which is in no UTF-8 text, ends it


@dataclass(frozen=True)
class PpmParams:
    folds: int = 10  # crc32(doc_id) mod folds = 0 is held out
    head: int = 200_000  # frequent words that each task is given, about (bounds its memory, not the result)
    head_grams: int = 1_000_000  # frequent n-grams likewise
    flush: int = 400_000  # distinct words or n-grams a task holds before it passes them on


def folded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower() if text else b""


def with_fold(docs: DataFrame, folds: int) -> DataFrame:
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0
    return docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))


# --- training counts --------------------------------------------------------------------------------------------


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with padding before and the end byte after each; the start of each text's symbols."""
    buffer = np.frombuffer(b"".join(x for t in texts for x in (PAD, t, b"\xff")), dtype=np.uint8)
    sizes = np.array([len(t) + len(PAD) + 1 for t in texts], dtype=np.int64)
    return buffer, np.cumsum(sizes) - sizes + len(PAD)


def gram_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram of every symbol, text after text, and how many symbols each text has."""
    buffer, starts = symbols(texts)
    key = np.zeros(len(buffer) - ORDER, np.int64)
    for k in range(ORDER + 1):
        key <<= 8
        key |= buffer[k : len(buffer) - ORDER + k]
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    real = np.repeat(starts - ORDER - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return key[real], sizes


def count_training(docs: DataFrame, flush: int) -> DataFrame:
    """(word, gram, n): word counts (gram null) and counts of n-grams (word null), partial per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        grams, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def rows(w: Counter, g: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            word = pa.array([*w.keys(), *[None] * len(g)], pa.binary())
            gram = pa.array(np.concatenate([np.zeros(len(w), np.int64), g]), pa.int64(), mask=np.arange(len(w) + len(g)) < len(w))
            n = pa.array(np.concatenate([np.fromiter(w.values(), np.int64, len(w)), s]), pa.int64())
            return pa.RecordBatch.from_arrays([word, gram, n], ["word", "gram", "n"])

        for some in chain.from_iterable(portions(b.column("text")) for b in batches):
            texts = [folded(t) for t in some]
            for t in texts:
                words.update(t.split())
                if len(words) > flush:
                    yield rows(words, grams[:0], sums[:0])
                    words = Counter()
            for part in _blocks(texts):
                g, s = np.unique(gram_keys(part)[0], return_counts=True)
                every = np.concatenate([grams, g])
                grams, at = np.unique(every, return_inverse=True)
                sums = np.bincount(at, np.concatenate([sums, s]), len(grams)).astype(np.int64)
                if len(grams) > flush:
                    yield rows(Counter(), grams, sums)
                    grams, sums = grams[:0], sums[:0]
        yield rows(words, grams, sums)

    return docs.select("text").mapInArrow(run, "word binary, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


def _blocks(texts: list[bytes], size: int = 1_000_000) -> Iterator[list[bytes]]:
    """Runs of texts of about so many bytes; one longer text is a run of its own."""
    part, have = [], 0
    for t in texts:
        part.append(t)
        have += len(t)
        if have >= size:
            yield part
            part, have = [], 0
    if part:
        yield part


# --- the model --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    """The contexts of one length: probabilities of what each has seen, and what an escape from it multiplies by."""

    gram: np.ndarray  # sorted; a context and a symbol after it
    p: np.ndarray
    context: np.ndarray  # sorted
    back: np.ndarray


def of_order(gram: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` context bytes and the symbol."""
    return gram & ((1 << 8 * (order + 1)) - 1)


def place(found: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``wanted`` is in the sorted ``found``, and whether it is there."""
    if not len(found):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(found, wanted), len(found) - 1)
    return at, found[at] == wanted


def level(gram: np.ndarray, n: np.ndarray, order: int, below: Level | None) -> Level:
    """From n-grams of at least this order that hold all of their contexts; ``below``: the level one byte shorter."""
    key, back = np.unique(of_order(gram, order), return_inverse=True)
    count = np.bincount(back, n, len(key))
    context, inverse, kinds = np.unique(key >> 8, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, count, len(context))
    shorter = below.p[place(below.gram, of_order(key, order - 1))[0]] if below is not None else np.full(len(key), 1 / 256)
    rest = 1 - np.bincount(inverse, shorter, len(context))  # of the shorter context: never 0, some bytes are in no text
    return Level(key, (count - 0.5) / total[inverse], context, kinds / (2 * total) / rest)  # method D


def low_levels(gram: np.ndarray, n: np.ndarray) -> list[Level]:
    """Contexts of no, one and two bytes, from counts of three-byte n-grams."""
    out: list[Level] = []
    for order in range(3):
        out.append(level(gram, n, order, out[-1] if out else None))
    return out


def log_probabilities(wanted: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of each wanted n-gram's last byte after the bytes before it."""
    out, open_ = np.zeros(len(wanted)), np.arange(len(wanted))
    for order in range(len(levels) - 1, -1, -1):
        x, key = levels[order], of_order(wanted[open_], order)
        at, hit = place(x.gram, key)
        out[open_[hit]] += np.log10(x.p[at[hit]])
        open_, key = open_[~hit], key[~hit]
        at, known = place(x.context, key >> 8)
        out[open_[known]] += np.log10(x.back[at[known]])
    out[open_] -= np.log10(256)
    return out


def settle(spark: SparkSession, grams: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, logp, n) of the distinct n-grams ``wanted`` (gram, n) under the trie of ``grams`` (gram, n)."""
    short = grams.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.sum("n").alias("n")).toArrow()  # at most 256^3 rows
    shared = spark.sparkContext.broadcast(low_levels(short["gram"].to_numpy(), short["n"].to_numpy().astype(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = shared.value

        def out(gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            levels, seen = list(low), n > 0
            for order in range(3, ORDER + 1):
                levels.append(level(gram[seen], n[seen], order, levels[-1]))
            asked = gram[~seen]
            return pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(log_probabilities(asked, levels), pa.float64()), pa.array(-n[~seen], pa.int64())], ["gram", "logp", "n"])

        parts, have = [], 0
        for b in batches:
            parts.append((b.column("gram").to_numpy(), b.column("n").to_numpy()))
            have += b.num_rows
            group = of_order(parts[-1][0] >> 8, 2)
            if have < 500_000 or group[-1] == of_order(parts[0][0][:1] >> 8, 2)[0]:
                continue
            gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            cut = int(np.searchsorted(of_order(gram >> 8, 2), group[-1]))  # the last group may go on
            yield out(gram[:cut], n[:cut])
            parts, have = [(gram[cut:], n[cut:])], len(gram) - cut
        if parts:
            yield out(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    # one group for each three last context bytes; groups come one after another
    both = grams.select("gram", "n").unionByName(wanted.select("gram", (-F.col("n")).alias("n")))  # below zero: asked for, so often
    group = F.shiftright("gram", 8).bitwiseAND(0xFFFFFF)
    return both.repartition(group).sortWithinPartitions(group).mapInArrow(run, "gram long, logp double, n long")


# --- scoring ----------------------------------------------------------------------------------------------------


def score_head(texts: list[bytes], head: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What the given n-grams add to each text's score; how many other n-grams each text has, and these with their numbers, text after text."""
    key, sizes = gram_keys(texts)
    kinds, back = np.unique(key, return_inverse=True)
    at, hit = place(head, kinds)
    value = np.where(hit, logp[at], 0.0) if len(head) else np.zeros(len(kinds))
    text = np.repeat(np.arange(len(texts)), sizes)
    scores = np.bincount(text, value[back], len(texts))
    left = np.flatnonzero(~hit[back])
    pair, times = np.unique(text[left] * len(kinds) + back[left], return_counts=True)
    return scores, np.bincount(pair // len(kinds), minlength=len(texts)), kinds[pair % len(kinds)], times


def score_texts(spark: SparkSession, docs: DataFrame, params: PpmParams = PpmParams()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row of ``docs``."""
    d = with_fold(docs, params.folds)
    training = d.where(~F.col("held_out"))
    counted = materialize(spark, count_training(training, params.flush), "counts")
    ends = training.count()
    words = counted.where("word is not null").select("word", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, v_all = total + ends, kinds + (ends > 0)  # the end is a token too

    grams = counted.where("gram is not null").select("gram", "n")
    often = most_frequent(grams, "n", params.head_grams, "gram").withColumn("context", F.shiftright("gram", 8))
    totals = grams.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.sum("n").alias("total"))
    given = often.join(totals, "context").select("gram", F.log10((F.col("n") - 0.5) / F.col("total")).alias("logp")).toArrow()
    order = np.argsort(given["gram"].to_numpy())
    head_gram, head_logp = given["gram"].to_numpy()[order], given["logp"].to_numpy()[order]

    scale = n_all + 0.1 * (v_all + 1)
    top = most_frequent(words, "n", params.head, "word").toArrow()
    head = dict(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast((head_gram, head_logp, head))
    end_score = float(np.log10((ends + 0.1) / scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, logp, known = shared.value
        logs = {w: float(np.log10((n + 0.1) / scale)) for w, n in known.items()}
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            texts = [folded(t) for t in b.column("text").to_pylist()]
            n_tokens, n_known, base, tails = [], [], [], []
            for t in texts:
                tokens = t.split()
                found = [logs[w] for w in tokens if w in logs]
                n_tokens.append(len(tokens) + 1)
                n_known.append(len(found) + (ends > 0))
                base.append(sum(found) + end_score)
                tails.append(list(Counter(w for w in tokens if w not in logs).items()) if len(found) < len(tokens) else [])
            scores, sizes, grams, times = (np.concatenate(x) for x in zip(*(score_head(part, gram, logp) for part in _blocks(texts)), strict=True))
            open_grams = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.StructArray.from_arrays([pa.array(grams), pa.array(times, pa.int64())], ["gram", "times"]))
            tail_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))
            tail = pa.array([[{"word": w, "n": n} for w, n in x] for x in tails], tail_type)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), tail, open_grams],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "tail", "grams"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<struct<word:binary,n:long>>, grams array<struct<gram:long,times:long>>"
    # written once: the rows' own numbers, by which the tails come back, must not change
    scored = materialize(spark, d.select(F.col("doc_id").cast("long"), "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()), "scored")
    tails = materialize(spark, scored.select("row", F.explode("tail").alias("t")).select("row", "t.word", F.col("t.n").alias("times")), "tails")
    # a word or n-gram that is not among the given ones may still be in many texts: those are no hot task
    asked_words = tails.groupBy("word").agg(F.count("*").alias("n")).join(words.select("word", F.col("n").alias("c")), "word", "left")
    c = F.coalesce(F.col("c"), F.lit(0))
    settled = join_hot(tails, materialize(spark, asked_words, "asked"), "word", tails.count()).groupBy("row").agg(
        F.sum(F.col("times") * F.log10((c + 0.1) / scale)).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known")
    )
    asked = materialize(spark, scored.select("row", F.explode("grams").alias("g")).select("row", "g.*"), "grams")
    found = materialize(spark, settle(spark, grams, asked.groupBy("gram").agg(F.count("*").alias("n"))), "settled")
    bytes_ = join_hot(asked, found, "gram", asked.count()).groupBy("row").agg(F.sum(F.col("times") * F.col("logp")).alias("more_score"))
    out = scored.drop("tail", "grams").join(settled, "row", "left").join(bytes_, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
