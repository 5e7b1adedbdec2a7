"""Answers kept for a while: a repeated question gets the stored answer until its time to live is over.

Only requests with a key are kept (see ``answer.cacheable``); others are always made anew. An entry lives from its writing; a
request within ``ttl_seconds`` of that is a hit and gets the stored answer, whatever its own would have been; a later one
writes again. The batch form reads each key's requests as a sorted stream in one task and holds one answer; requests without key need no
order and stay where they are, so they make no hot key. The bound on entries is left out, as it depends on all keys at once.

Null keys are empty ones; null times count as the earliest; ties in time go by the request's number; repeated rows are requests of their
own; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quernstone.config import CacheParams
from quernstone.streaming.limits import _due, in_range, keep_state_in_rocksdb

RESULT = "request_id long, hit boolean, answer string"


def replay(requests: DataFrame, params: CacheParams = CacheParams()) -> DataFrame:
    """request_id, hit, answer of ``requests`` (request_id, cache_key, at timestamp, answer: what a miss would make)."""
    ttl = params.ttl_seconds * 1_000_000
    rows = requests.select(F.col("request_id").cast("long").alias("request_id"), F.coalesce("cache_key", F.lit("")).alias("cache_key"), F.coalesce(F.unix_micros("at"), F.lit(-(2**62))).alias("at"), "answer")
    alone = rows.where("cache_key = ''").select("request_id", F.lit(False).alias("hit"), "answer")
    kept = rows.where("cache_key <> ''").repartition("cache_key").sortWithinPartitions("cache_key", "at", "request_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, made, stored = None, 0, None
        for b in batches:
            hits, answers = [], []
            for k, at, answer in zip(b["cache_key"], b["at"], b["answer"], strict=True):
                hit = k == key and at - made <= ttl
                if not hit:
                    key, made, stored = k, at, answer
                hits.append(hit)
                answers.append(stored)
            yield pd.DataFrame({"request_id": b["request_id"], "hit": hits, "answer": answers})

    return kept.mapInPandas(run, RESULT).unionByName(alone)


class _Store(StatefulProcessor):
    """Of a share of the keys: requests that may still get earlier ones, and the stored answers by key."""

    def __init__(self, params: CacheParams):
        self.ttl = params.ttl_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, request_id long, cache_key string, answer string")
        self.answers = handle.getMapState("answers", "cache_key string", "made long, answer string")
        self.swept = handle.getValueState("swept", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for b in rows:
            texts = [None if pd.isna(a) else a for a in b["answer"]]
            self.pending.appendList(list(zip(b["at"].tolist(), b["request_id"].tolist(), b["cache_key"].tolist(), texts, strict=True)))
            self.handle.registerTimer(_due(min(b["at"].tolist())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        pending = sorted(self.pending.get(), key=lambda x: x[:2])
        later = [x for x in pending if x[0] > upto]
        out = []
        for at, request_id, k, answer in pending[: len(pending) - len(later)]:
            entry = self.answers.getValue((k,)) if k else None
            hit = entry is not None and at - entry[0] <= self.ttl
            if k and not hit:
                self.answers.updateValue((k,), (at, answer))
            out.append((request_id, hit, entry[1] if hit else answer))
        swept = self.swept.get()
        if swept is None or upto - swept[0] > self.ttl:  # once in a time to live, all that is over goes
            for k in [k for k, (made, _) in self.answers.iterator() if upto - made > self.ttl]:
                self.answers.removeKey(k)
            self.swept.update((upto,))
        if later:
            self.pending.put(later)
            self.handle.registerTimer(_due(later[0][0]))
        else:
            self.pending.clear()
            if self.answers.exists() and any(True for _ in self.answers.keys()):
                self.handle.registerTimer(_due(upto + self.ttl + 1000))
            elif not out:
                self.swept.clear()
        return iter([pd.DataFrame(out, columns=["request_id", "hit", "answer"])] if out else ())

    def close(self) -> None:
        pass


def replay_stream(requests: DataFrame, params: CacheParams = CacheParams(), delay_seconds: int = 60, shares: int = 64) -> DataFrame:
    """``replay`` over a stream: a request is answered once the watermark has passed it, so the cut into batches, restarts and order
    within ``delay_seconds`` don't matter; later ones are dropped. Keys are dealt to ``shares`` stores, each a map of its answers;
    requests without key are dealt by their number."""
    keep_state_in_rocksdb(requests.sparkSession)
    timed = requests.where(in_range("at")).withWatermark("at", f"{delay_seconds} seconds")
    key = F.coalesce("cache_key", F.lit(""))
    share = F.pmod(F.xxhash64(key, F.when(key == "", F.col("request_id"))), F.lit(shares)).alias("share")
    rows = timed.select(share, F.col("at").alias("ts"), F.unix_micros("at").alias("at"), F.col("request_id").cast("long").alias("request_id"), key.alias("cache_key"), "answer")
    return rows.groupBy("share").transformWithStateInPandas(_Store(params), RESULT, "append", "EventTime")
