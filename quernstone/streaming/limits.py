"""Keyed state over time: sliding admission, answers kept for a while, monthly quotas.

Admission depends on its own past decisions (rejected events take no slot), so no window function gives it. The batch
form runs over the events of a key in order; the streaming form keeps what it needs as keyed state with event-time timers. A key
whose events don't fit one task's memory is no problem for the batch form: it reads them as sorted batches, and its
state is at most ``limit`` times. But its events are judged one after another, as each decision depends on those before:
a client with a third of all events is one long task, in either form.

Rows with a null time come first and are judged as of one moment; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quernstone.config import CacheParams, LimiterParams, QuotaParams


def _micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def _sorted_scan(events: DataFrame, key: str, time: str, order: str, extra: list[str], schema: str, step) -> DataFrame:
    """Each key's events in time order through ``step`` (fresh for each key): batches stream by, nothing is held but state."""
    cols = [key, order, *extra]
    dealt = events.select(*cols, _micros(time).alias("_t")).repartition(key).sortWithinPartitions(key, "_t", order)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, judge, begun = None, None, False
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                k = None if pd.isna(row[0]) else row[0]
                if not begun or k != now:
                    now, judge, begun = k, step(), True
                out.append(judge(row))
            yield b.drop(columns="_t").assign(result=out)

    return dealt.mapInPandas(run, schema)


def admit(events: DataFrame, key: str, time: str, order: str, params: LimiterParams = LimiterParams()) -> DataFrame:
    """key, order, admitted: fewer than ``limit`` admitted events in the window before; rejected ones don't count.

    Rows of a null key are one client; ties in time go by ``order``.
    """
    span, limit = params.window_seconds * 1_000_000, params.limit

    def step():
        times: deque[int] = deque()

        def judge(row) -> bool:
            while times and row[-1] - times[0] >= span:
                times.popleft()
            if len(times) >= limit:
                return False
            times.append(row[-1])
            return True

        return judge

    types = dict(events.dtypes)
    return _sorted_scan(events, key, time, order, [], f"{key} {types[key]}, {order} {types[order]}, result boolean", step).withColumnRenamed("result", "admitted")


def cache_hits(events: DataFrame, key: str, time: str, order: str, params: CacheParams = CacheParams()) -> DataFrame:
    """key, order, hit: an entry lives ``ttl_seconds`` from its writing; a miss writes. The bound on entries is left out, as
    it depends on all keys at once."""
    ttl = params.ttl_seconds * 1_000_000

    def step():
        made: list[int] = []

        def judge(row) -> bool:
            if made and row[-1] - made[0] <= ttl:
                return True
            made[:] = [row[-1]]
            return False

        return judge

    types = dict(events.dtypes)
    return _sorted_scan(events, key, time, order, [], f"{key} {types[key]}, {order} {types[order]}, result boolean", step).withColumnRenamed("result", "hit")


def monthly_quota(events: DataFrame, key: str, time: str, order: str, params: QuotaParams = QuotaParams()) -> DataFrame:
    """key, order, month, used, allowed: the first ``limit`` events of a key and calendar month pass."""
    month = F.date_format(time, "yyyy-MM")
    w = Window.partitionBy(key, "month").orderBy(time, order)
    used = events.withColumn("month", month).withColumn("used", F.row_number().over(w))
    return used.select(key, order, "month", "used", (F.col("used") <= params.limit).alias("allowed"))


def answered_quota(questions: DataFrame, key: str, time: str, order: str, answered: str, exempt: str, params: QuotaParams = QuotaParams()) -> DataFrame:
    """key, order, month, used, allowed: a question passes until ``limit`` answered ones of its key and month came before it.

    Only questions that got an answer (``answered``) count, and none of those with the plan (``exempt``), which always pass. What
    is not allowed is not asked, so the count stops at the limit. Null flags are false.
    """
    month = F.date_format(time, "yyyy-MM")
    counts = F.coalesce(F.col(answered), F.lit(False)) & ~F.coalesce(F.col(exempt), F.lit(False))
    before = Window.partitionBy(key, "month").orderBy(time, order).rowsBetween(Window.unboundedPreceding, -1)
    used = questions.withColumn("month", month).withColumn("used", F.least(F.coalesce(F.count_if(counts).over(before), F.lit(0)), F.lit(params.limit)))
    return used.select(key, order, "month", "used", (F.coalesce(F.col(exempt), F.lit(False)) | (F.col("used") < params.limit)).alias("allowed"))


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State with lists, maps and timers needs this store; queries take the setting with them when they start."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Admission(StatefulProcessor):
    """Of a client: events that may still get earlier ones (pending), and the times admitted within the last window."""

    def __init__(self, params: LimiterParams):
        self.span, self.limit = params.window_seconds * 1_000_000, params.limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, event_id long")
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for b in rows:
            self.pending.appendList(list(zip(b["at"].tolist(), b["event_id"].tolist(), strict=True)))
            self.handle.registerTimer(_due(min(b["at"].tolist())))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        pending = sorted(self.pending.get())
        ready, later = [x for x in pending if x[0] <= upto], [x for x in pending if x[0] > upto]
        times = deque(t for (t,) in self.times.get())
        out = []
        for at, event_id in ready:
            while times and at - times[0] >= self.span:
                times.popleft()
            admitted = len(times) < self.limit
            if admitted:
                times.append(at)
            out.append((key[0], event_id, admitted))
        while times and upto - times[0] >= self.span:  # what no later event can meet
            times.popleft()
        for state, rows in ((self.pending, later), (self.times, [(t,) for t in times])):
            state.put(rows) if rows else state.clear()
        if later or times:  # a client without either has no state left
            self.handle.registerTimer(_due(min(later[0][0] if later else math.inf, times[0] + self.span if times else math.inf)))
        return iter([pd.DataFrame(out, columns=["client", "event_id", "admitted"])] if out else ())

    def close(self) -> None:
        pass


def in_range(time: str) -> Column:
    """Times that a pandas column can hold; others, and nulls, can't go to a state that Python keeps."""
    return F.col(time).between(F.lit("1678-01-01").cast("timestamp"), F.lit("2262-01-01").cast("timestamp"))


def _due(at: float) -> int:
    """The first millisecond at which a watermark has passed ``at`` (microseconds)."""
    return -(-int(at) // 1000)


def admit_stream(events: DataFrame, params: LimiterParams = LimiterParams(), delay_seconds: int = 60) -> DataFrame:
    """The limiter over a stream of (client, event_id long, at timestamp): client, event_id, admitted, as ``admit`` judges them.

    An event is judged, in order of (at, event_id), once the watermark (the latest time seen, less ``delay_seconds``) has passed
    it, so decisions depend neither on the cut into micro-batches nor on restarts, and events out of order by up to the delay
    are judged in place. Later ones are dropped without a decision. Timers of event time judge, and remove the times that have left the
    window; a client without pending events and admitted times has no state. Events without a time, or outside the
    years 1678 to 2261, are dropped.
    """
    keep_state_in_rocksdb(events.sparkSession)
    timed = events.where(in_range("at")).withWatermark("at", f"{delay_seconds} seconds")
    # keys as strings that are never null: pandas turns numbers to floats where one is missing, and state would mix clients up
    key = F.coalesce(F.concat(F.lit("="), F.col("client").cast("string")), F.lit(""))
    rows = timed.select(key.alias("client"), "event_id", F.col("at").alias("ts"), F.unix_micros("at").alias("at"))
    judged = rows.groupBy("client").transformWithStateInPandas(_Admission(params), "client string, event_id long, admitted boolean", "append", "EventTime")
    return judged.withColumn("client", F.when(F.col("client") != "", F.expr("substring(client, 2)").cast(dict(events.dtypes)["client"])))


def run_to_end(stream: DataFrame, path: str) -> DataFrame:
    """Run ``stream`` over what is there, with its progress under ``path``, and read all that it has written so far."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
