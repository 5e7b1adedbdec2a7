"""Phrases of a table against the rules written as one expression a phrase."""

from pyspark.sql import functions as F

from quernstone.functions.text import normalize_intent
from quernstone.operators import intent, phrases

TEXTS = [(1, "When does my green card expire?"), (2, "card"), (3, None), (4, ""), (5, "greencards and renewals, renewal fees"), (6, "我的绿卡什么时候到期"), (7, "My Green-Card"), (8, "green card green card"), (9, "renew")]
TERMS = [("card", "green card"), ("card", "green cards"), ("fee", "fees"), ("fee", ""), ("zh", "绿卡"), ("renew", "renewal"), ("ren", "ren")]


def frames(spark):
    return spark.createDataFrame(TEXTS, "id int, text string"), spark.createDataFrame(TERMS, "intent string, term string")


def test_exact_intents_equal_the_expression(spark):
    texts, terms = frames(spark)
    got = {(r.id, r.intent): r.score for r in phrases.intent_scores(texts, ["id"], terms).collect()}
    by = {}
    for name, term in TERMS:
        by.setdefault(name, []).append(term)
    normal = {k: tuple(r.t for r in spark.createDataFrame([(t,) for t in v], "t string").select(normalize_intent(F.col("t")).alias("t")).collect()) for k, v in by.items()}
    rows = intent.intent_scores(texts, normal).collect()
    assert got == {(r.id, k): r[k] for r in rows for k in by if r[k]} and got[(1, "card")] == 6 and got[(6, "zh")] == 5
    assert phrases.intent_scores(texts, ["id"], terms.limit(0)).count() == 0 and phrases.intent_scores(texts.limit(0), ["id"], terms).count() == 0


def test_scores_equal_the_expression(spark):
    texts, terms = frames(spark)
    p = terms.select(normalize_intent(F.col("term")).alias("phrase")).distinct()
    got = {(r.id, r.phrase): round(r.score, 9) for r in phrases.match_scores(texts, ["id"], p).collect()}
    pairs = texts.select("id", normalize_intent(F.col("text")).alias("q")).crossJoin(p).withColumn("s", intent.match_score(F.col("q"), F.col("phrase"))).where("s > 0").collect()
    assert got == {(r.id, r.phrase): round(r.s, 9) for r in pairs} and len(got) > 10


def test_best_topic_takes_the_first_of_equals(spark):
    texts, _ = frames(spark)
    t = spark.createDataFrame([(0, "a", "green card"), (1, "b", "green card"), (2, "c", "renewal fees"), (2, "c", "renewal fees")], "topic_ord int, topic string, phrase string")
    got = {r.id: r.topic for r in phrases.best_topic(texts, ["id"], t).collect()}
    assert got[1] == got[8] == "a" and got[5] == "c" and got[3] == got[4] == got[6] == "general"


def test_substrings_of_every_length(spark):
    texts = spark.createDataFrame([(1, "abcdefghijk"), (2, "xyz"), (3, "")], "id int, t string")
    p = spark.createDataFrame([(x,) for x in ("a", "ijk", "abcdef", "bcdefgh", "bcdefgx", "abcdefghijkl", "")], "phrase string")
    assert sorted(tuple(r) for r in phrases.inside_hits(texts, ["id"], "t", p).collect()) == [(1, "a"), (1, "abcdef"), (1, "bcdefgh"), (1, "ijk")]


def test_pairs_of_texts_and_phrases_are_not_shuffled(spark, capsys):
    texts, terms = frames(spark)
    phrases.best_topic(texts, ["id"], terms.selectExpr("0 as topic_ord", "intent as topic", "term as phrase")).explain()
    plan = capsys.readouterr().out.splitlines()
    summed = [i for i, line in enumerate(plan) if "[sum(times" in line]
    assert summed and all("partial_sum(times" in plan[i + 1] for i in summed)  # no exchange between the two halves of the sum
