"""Rule scoring of utterances: exact intents, fuzzy topics, steps of a checklist. Dimensions are small constant tables.

Null texts count as empty and score 0; ties go to the first of the dimension; empty tables give empty results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.config import STEP_STOP_WORDS
from quernstone.functions.text import normalize_intent, text_tokens

#: Scripts without word spaces, or with endings that stick to the word: terms match anywhere.
UNSPACED = r"[\p{IsHan}\p{IsDevanagari}\p{IsArabic}\p{IsBengali}\p{IsCyrillic}]"


def exact_score(query: Column, term: Column) -> Column:
    """4 + words of the term, 10 at most, if a normalised term is a phrase of the normalised query; else 0."""
    free = term.rlike(UNSPACED)
    phrase = F.when(free, query.contains(term)).otherwise(F.concat(F.lit(" "), query, F.lit(" ")).contains(F.concat(F.lit(" "), term, F.lit(" "))))
    hit = (query != "") & (term != "") & phrase
    return F.when(hit, F.least(F.lit(10), 4 + F.size(F.split(term, " ")))).otherwise(0)


def intent_scores(utterances: DataFrame, terms: dict[str, tuple[str, ...]]) -> DataFrame:
    """One column for each intent: the best score of its terms over ``utterances`` (text; other columns stay)."""
    q = utterances.withColumn("_q", normalize_intent(F.col("text")))
    return q.withColumns({name: reduce(F.greatest, [exact_score(F.col("_q"), F.lit(t)) for t in words], F.lit(0)).cast("int") for name, words in terms.items()}).drop("_q")


def match_score(query: Column, candidate: Column) -> Column:
    """Likeness of two normalised texts: 12 if equal; containment 4 + words, 10 at most; else matched words, coverage, density."""
    qt, ct = text_tokens(query), text_tokens(candidate)

    def alike(c: Column, w: Column) -> Column:
        inside = (F.length(c) > 4) & (F.length(w) > 4) & (c.contains(w) | w.contains(c))
        return w.startswith(c) | c.startswith(w) | inside

    matched = F.size(F.filter(ct, lambda c: F.exists(qt, lambda w: alike(c, w)))).cast("double")
    words = F.when(matched > 0, matched + 2 * matched / F.size(ct) + matched / F.greatest(F.size(qt), F.lit(1))).otherwise(0.0)
    contained = F.when(query.contains(candidate) | candidate.contains(query), F.least(F.lit(10), 4 + F.size(ct)).cast("double")).otherwise(0.0)
    return F.when((query == "") | (candidate == ""), 0.0).when(query == candidate, 12.0).otherwise(F.greatest(contained, words))


def best_topic(utterances: DataFrame, topics: list[tuple[str, tuple[str, ...]]], least: float = 1.0, otherwise: str = "general") -> DataFrame:
    """topic and topic_score of each row of ``utterances`` (text): the best topic, the first of equals."""
    q = utterances.withColumn("_q", normalize_intent(F.col("text")))
    scored = F.array(*[F.struct(reduce(F.greatest, [match_score(F.col("_q"), F.lit(p)) for p in phrases], F.lit(0.0)).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, phrases) in enumerate(topics)])
    best = q.withColumn("_b", F.array_max(scored))
    good = F.col("_b.s") >= least
    return best.withColumns({"topic": F.when(good, F.col("_b.name")).otherwise(otherwise), "topic_score": F.round(F.col("_b.s"), 4)}).drop("_q", "_b")


def find_step(queries: DataFrame, steps: DataFrame, stop_words: tuple[str, ...] = STEP_STOP_WORDS) -> DataFrame:
    """query_id, step_id: the step that a text names. ``steps``: flow_id, step_ord, step_id, parts (array of texts).

    Containment either way counts 999, and of such steps the last wins; otherwise the best score of 1 or more, the first of equals.
    """
    q = queries.select("query_id", "flow_id", normalize_intent(F.col("text")).alias("q"))
    parts = steps.select("flow_id", "step_ord", "step_id", F.posexplode("parts").alias("_n", "part")).withColumn("part", normalize_intent(F.col("part")))
    grouped = parts.groupBy("flow_id", "step_ord", "step_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "part"))), lambda x: x["part"]).alias("parts"))
    both = q.join(grouped, "flow_id")
    inside = F.exists("parts", lambda p: (p != "") & (F.col("q").contains(p) | p.contains(F.col("q"))))
    words = F.filter(F.split("q", " "), lambda w: (F.length(w) > 2) & ~w.isin(list(stop_words) or [""]))
    hits = F.size(F.filter(words, lambda w: F.array_join("parts", " ").contains(w))).cast("double")
    fuzzy = F.coalesce(F.array_max(F.transform("parts", lambda p: match_score(F.col("q"), p))), F.lit(0.0))
    scored = both.withColumn("inside", inside).withColumn("score", F.when(F.col("inside"), 999.0).otherwise(F.greatest(hits, fuzzy))).where("score >= 1")
    order = F.struct("score", F.when(F.col("inside"), F.col("step_ord")).otherwise(-F.col("step_ord")))
    return scored.groupBy("query_id").agg(F.max_by("step_id", order).alias("step_id"), F.max("score").alias("score"))


def first_rule(text: Column, rules: list[tuple[tuple[str, ...], str]], otherwise: str) -> Column:
    """The value of the first rule one of whose terms is a substring of ``text``."""
    out = None
    for terms, value in rules:
        hit = reduce(lambda a, b: a | b, [text.contains(t) for t in terms])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(otherwise)


def flow_match(utterances: DataFrame, flows: dict[str, tuple[str, ...]], least: float = 4.0) -> DataFrame:
    """The checklist that a text names, null below ``least``."""
    found = best_topic(utterances, list(flows.items()), least, "")
    return found.withColumn("flow_id", F.nullif("topic", F.lit(""))).drop("topic", "topic_score")
