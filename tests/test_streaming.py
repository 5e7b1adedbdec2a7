"""Streams against their batch forms: several micro-batches, disorder, restarts, late rows, state that goes."""

import random

import pytest
from pyspark.sql import functions as F

from quernstone.config import CacheParams, LimiterParams
from quernstone.streaming import answers, limits

END = 4_000_000_000  # seconds; a far row lets the watermark pass all others


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def in_files(spark, rows, schema, path, parts):
    """Rows as files that come one after another."""
    for i in range(parts):
        spark.createDataFrame(rows[i :: parts] if parts > 1 else rows, schema).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(path)


def streamed(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_numbers_as_clients_with_a_null_among_them(spark, tmp_path):
    rows = [(c, i, 100 + 50 * (i // 40)) for i, c in enumerate([None, *range(39)] * 4)]
    plain = spark.createDataFrame(rows, "client long, event_id long, at long").withColumn("ts", F.timestamp_seconds("at"))
    want = sorted(map(repr, limits.admit(plain, "client", "ts", "event_id", LimiterParams(2, 120)).collect()))
    source, at = str(tmp_path / "in"), str(tmp_path / "run")
    in_files(spark, [*rows, (-1, 999, END)], "client long, event_id long, at long", source, 1)
    got = limits.run_to_end(limits.admit_stream(streamed(spark, source), LimiterParams(2, 120)), at)
    assert sorted(repr(r) for r in got.collect() if r.event_id < 999) == want


EVENT = "client string, event_id long, at long"


def test_limiter_equals_the_batch_form_over_batches_and_restarts(spark, tmp_path):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None]), i, r.randint(0, 3000)) for i in range(60)]
    plain = spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_seconds("at"))
    want = sorted(map(repr, limits.admit(plain, "client", "ts", "event_id", LimiterParams(3, 600)).collect()))
    source, at = str(tmp_path / "in"), str(tmp_path / "run")
    in_files(spark, rows, EVENT, source, 2)
    first = limits.run_to_end(limits.admit_stream(streamed(spark, source), LimiterParams(3, 600), 4000), at).count()
    in_files(spark, [("z", 999, END)], EVENT, source, 1)  # a second run goes on where the first ended
    got = limits.run_to_end(limits.admit_stream(streamed(spark, source), LimiterParams(3, 600), 4000), at).where("client is null or client <> 'z'")
    assert first < 60 and sorted(map(repr, got.collect())) == want


def test_late_events_get_no_decision_and_idle_clients_no_state(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "run")
    for rows in ([("a", 1, 1000)], [("b", 2, 5000)], [("a", 3, 1001), ("a", 4, None)], [("z", 9, END)]):
        in_files(spark, rows, EVENT, source, 1)
        got = limits.run_to_end(limits.admit_stream(streamed(spark, source), LimiterParams(3, 600), 60), at)
    assert sorted(r.event_id for r in got.collect()) == [1, 2]  # 3 came after the watermark had passed it
    state = spark.read.format("statestore").option("stateVarName", "times").load(f"{at}/progress")
    assert {r.key.client for r in state.select("key").collect()} <= {"=z"}


REQUEST = "request_id long, cache_key string, at long, answer string"
REQUESTS = [(1, "k", 1000, "one"), (2, "k", 1100, "two"), (3, "k", 1301, "three"), (4, "k", 1600, "four"), (5, "", 1000, "five"), (6, None, 1001, "six"), (7, "j", 1050, None), (8, "j", 1060, "eight"), (9, "k", 1301, "nine")]
ANSWERED = [(1, False, "one"), (2, True, "one"), (3, False, "three"), (4, True, "three"), (5, False, "five"), (6, False, "six"), (7, False, None), (8, True, None), (9, True, "three")]


def test_answers_are_given_back_until_they_expire(spark):
    rows = spark.createDataFrame(REQUESTS, REQUEST).withColumn("at", F.timestamp_seconds("at"))
    assert sorted(map(tuple, answers.replay(rows, CacheParams(300)).collect())) == ANSWERED
    assert answers.replay(rows.limit(0)).count() == 0


def test_answer_stream_equals_the_batch_form(spark, tmp_path):
    source, at = str(tmp_path / "in"), str(tmp_path / "run")
    in_files(spark, REQUESTS, REQUEST, source, 3)
    in_files(spark, [(99, "", END, "")], REQUEST, source, 1)
    got = limits.run_to_end(answers.replay_stream(streamed(spark, source), CacheParams(300), 1000, 4), at).where("request_id < 99")
    assert sorted(map(tuple, got.collect())) == ANSWERED
