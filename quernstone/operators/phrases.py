"""Phrases of a large table found in texts: query expansion, exact intents and the best topic, by equi-joins.

The dimension is a DataFrame of any size, not a list in the plan: a phrase that has to stand between spaces is looked up among
the word n-grams of a text (of the lengths that phrases have), one that may stand anywhere by its first characters at every
place of the text, then compared whole. Words that are alike (one begins with the other, or holds it and both are long) are paired
once for all distinct words. Only keys, n-grams and numbers move; texts are joined again to the few pairs that need them. A small side is
broadcast by its measured size, a large one shuffled; hot n-grams are split by adaptive skew joins.

Texts and phrases are normalised by the caller's choice before; null and empty ones match nothing and score 0. Repeated phrases of a topic
count once. Key columns must tell rows of texts apart; rows with a null in the key match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import normalize, normalize_intent, stem, text_tokens, tokens_of
from quernstone.operators.intent import UNSPACED

#: Characters by which a phrase that may stand anywhere is looked up.
ANCHOR = 6
#: Rows of phrases (of their words) up to which they are broadcast.
BROADCAST = 200_000
#: Words count as long from here on.
LONG = 5


def word_grams(words: Column, sizes: list[int]) -> Column:
    """All runs of as many words as ``sizes`` says, each once."""
    of = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def _pieces(text: Column, sizes: list[int]) -> Column:
    """All substrings of as many characters as ``sizes`` says, each once."""
    of = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[of(n) for n in sizes]))


def _sizes(phrases: DataFrame, size: Column) -> list[int]:
    """The distinct sizes: as many as the longest phrase has at most."""
    return sorted(r.n for r in phrases.select(size.alias("n")).distinct().collect() if r.n)


def whole_hits(texts: DataFrame, key: list[str], text: str, phrases: DataFrame) -> DataFrame:
    """(key, phrase): phrases (phrase) of single-spaced words that stand in the single-spaced ``text`` between spaces or ends."""
    kept = phrases.select("phrase").where("phrase <> ''").distinct()
    sizes = _sizes(kept, F.size(F.split("phrase", " ")))
    if not sizes:
        return texts.select(*key, F.lit("").alias("phrase")).limit(0)
    return texts.where(F.col(text) != "").select(*key, F.explode(word_grams(F.split(text, " "), sizes)).alias("phrase")).join(kept, "phrase").select(*key, "phrase")


def inside_hits(texts: DataFrame, key: list[str], text: str, phrases: DataFrame) -> DataFrame:
    """(key, phrase): phrases (phrase) that are substrings of ``text``."""
    kept = phrases.select("phrase").where("phrase <> ''").distinct().withColumn("_begin", F.left("phrase", F.lit(ANCHOR)))
    sizes = _sizes(kept, F.length("_begin"))
    if not sizes:
        return texts.select(*key, F.lit("").alias("phrase")).limit(0)
    places = texts.select(*key, F.explode(_pieces(F.col(text), sizes)).alias("_begin"))
    sure = places.join(kept.where(F.length("phrase") <= ANCHOR), "_begin").select(*key, "phrase")
    maybe = places.join(kept.where(F.length("phrase") > ANCHOR), "_begin").select(*key, "phrase")
    return sure.unionByName(maybe.join(texts.select(*key, F.col(text).alias("_text")), key).where(F.col("_text").contains(F.col("phrase"))).select(*key, "phrase"))


def intent_scores(utterances: DataFrame, key: list[str], terms: DataFrame) -> DataFrame:
    """(key, intent, score) where some term of ``terms`` (intent, term) is a phrase of the text: 4 + words of the best, 10 at most."""
    q = utterances.select(*key, normalize_intent(F.col("text")).alias("q"))
    t = terms.select("intent", normalize_intent(F.col("term")).alias("phrase")).distinct()
    free = F.col("phrase").rlike(UNSPACED)
    found = whole_hits(q, key, "q", t.where(~free)).unionByName(inside_hits(q, key, "q", t.where(free)))
    score = F.least(F.lit(10), 4 + F.size(F.split("phrase", " ")))
    return found.join(t, "phrase").groupBy(*key, "intent").agg(F.max(score).alias("score"))


def expand_queries(queries: DataFrame, topics: DataFrame) -> DataFrame:
    """As ``search.analyze_queries`` for a table of ``topics`` (topic_ord, phrases, terms, paths): query_id, normalized, terms, own, paths."""
    q = queries.select("query_id", normalize(F.col("text")).alias("normalized"))
    phrases = topics.select("topic_ord", F.explode("phrases").alias("phrase"))
    fired = inside_hits(q, ["query_id"], "normalized", phrases).join(phrases, "phrase").select("query_id", "topic_ord").distinct()
    named = fired.join(topics.select("topic_ord", F.transform("terms", stem).alias("terms"), "paths"), "topic_ord")
    # a query's topics are few: they meet in one row of it
    added = named.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("topic_ord", "terms", "paths"))).alias("t"))
    own = tokens_of(F.col("normalized"))
    all_of = lambda c: F.coalesce(F.flatten(F.transform("t", lambda x: x[c])), F.array().cast("array<string>"))
    return q.join(added, "query_id", "left").select("query_id", "normalized", F.array_distinct(F.concat(own, all_of("terms"))).alias("terms"), F.size(F.array_distinct(own)).alias("own"), F.array_distinct(all_of("paths")).alias("paths"))


def alike_words(some: DataFrame, others: DataFrame) -> DataFrame:
    """(w, c): words w of ``some`` (w) and c of ``others`` (c) of which one begins with the other, or holds it where both are long."""
    begins = lambda x: F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.left(x, i))
    up = some.select("w", F.explode(begins(F.col("w"))).alias("c")).join(others, "c")
    down = others.select("c", F.explode(begins(F.col("c"))).alias("w")).join(some, "w")
    long_w, long_c = some.where(F.length("w") >= LONG), others.where(F.length("c") >= LONG)
    at = lambda x: F.explode(_pieces(F.col(x), [LONG])).alias("_at")
    held = long_w.select("w", at("w")).join(long_c.select("c", F.left("c", F.lit(LONG)).alias("_at")), "_at").where(F.col("w").contains(F.col("c")))
    holds = long_c.select("c", at("c")).join(long_w.select("w", F.left("w", F.lit(LONG)).alias("_at")), "_at").where(F.col("c").contains(F.col("w")))
    return up.select("w", "c").unionByName(down.select("w", "c")).unionByName(held.select("w", "c")).unionByName(holds.select("w", "c")).distinct()


def _scores(utterances: DataFrame, key: list[str], phrases: DataFrame) -> DataFrame:
    """(key, phrase, score > 0), perhaps several of a pair, of which the largest counts.

    Nearly every text has some word like one of nearly every phrase. So the words go by the text's key once and are added up
    where they are: pairs of texts and phrases do not move, unless the phrases are too many to be broadcast.
    """
    q = utterances.select(*key, normalize_intent(F.col("text")).alias("q"))
    p = phrases.select("phrase").where("phrase <> ''").distinct()
    said = q.select(*key, F.size(text_tokens(F.col("q"))).alias("n_q"), F.explode(F.array_distinct(text_tokens(F.col("q")))).alias("w"))
    asked = p.select("phrase", F.explode(text_tokens(F.col("phrase"))).alias("c")).groupBy("phrase", "c").agg(F.count("*").alias("times"))
    few = F.broadcast if asked.count() <= BROADCAST else lambda df: df
    alike = alike_words(said.select("w").distinct(), asked.select("c").distinct())
    parts = int(utterances.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a word of a phrase counts once, however many words of the text are like it
    met = said.join(alike, "w").select(*key, "n_q", "c").repartition(parts, *key).groupBy(*key, "c").agg(F.max("n_q").alias("n_q"))
    met = met.join(few(asked), "c").groupBy(*key, "phrase").agg(F.sum("times").cast("double").alias("matched"), F.max("n_q").alias("n_q"))
    n_c = F.size(text_tokens(F.col("phrase")))
    words = met.select(*key, "phrase", (F.col("matched") + 2 * F.col("matched") / n_c + F.col("matched") / F.greatest("n_q", F.lit(1))).alias("score"))
    # containment either way; equal texts are both
    holds = inside_hits(q, key, "q", p)
    texts = q.where("q <> ''").select(F.col("q").alias("phrase")).distinct()
    held = inside_hits(p.select(F.col("phrase").alias("p")), ["p"], "p", texts).select(F.col("p"), F.col("phrase").alias("q")).join(q, "q").select(*key, F.col("p").alias("phrase"))
    contained = holds.unionByName(held).distinct().join(q, key).select(*key, "phrase", F.when(F.col("q") == F.col("phrase"), 12.0).otherwise(F.least(F.lit(10), 4 + n_c).cast("double")).alias("score"))
    return words.unionByName(contained)


def match_scores(utterances: DataFrame, key: list[str], phrases: DataFrame) -> DataFrame:
    """(key, phrase, score > 0): likeness of each text and each of ``phrases`` (phrase, normalised), as ``intent.match_score`` has it."""
    return _scores(utterances, key, phrases).groupBy(*key, "phrase").agg(F.max("score").alias("score"))


def best_topic(utterances: DataFrame, key: list[str], topics: DataFrame, least: float = 1.0, otherwise: str = "general") -> DataFrame:
    """key, topic, topic_score of every row: the best of ``topics`` (topic_ord, topic, phrase), the first of equals; ``otherwise`` below ``least``."""
    t = topics.select("topic_ord", "topic", normalize_intent(F.col("phrase")).alias("phrase")).distinct()
    few = F.broadcast if t.count() <= BROADCAST else lambda df: df
    scored = _scores(utterances, key, t).join(few(t), "phrase")
    best = scored.groupBy(*key).agg(F.max(F.struct("score", (-F.col("topic_ord")).alias("o"), "topic")).alias("b"))
    out = utterances.select(*key).join(best, key, "left")
    score = F.coalesce("b.score", F.lit(0.0))
    return out.select(*key, F.when(score >= least, F.col("b.topic")).otherwise(otherwise).alias("topic"), F.round(score, 4).alias("topic_score"))
