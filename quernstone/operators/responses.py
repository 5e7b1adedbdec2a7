"""Raw responses of a model, from attempts to answers: choice of the attempt, parts, citations, sections, fallback.

A response is JSON text; it is read by schema, and one that can't be read counts as a failed one. Paragraphs and annotations
are rows: an annotation meets the paragraphs it overlaps by a join on stretches of the text (bins), so that neither the
annotations nor the paragraphs of a long answer meet in one row; only offsets move. Sources are few for each answer and end
up in arrays.

A null or empty body, one without text and one with a status outside 200 to 299 give the local answer. Annotations without a
start or an address belong nowhere. Repeated attempts of one number count as one of them, the first of equals by body. Request numbers must tell
requests apart; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.config import OFFICIAL_DOMAINS, AnswerParams, Topic
from quernstone.functions.text import normalize_routing
from quernstone.operators.answer import cache_key, cacheable, clean_output, follow_ups, last_user_turns, local_answer, resolve_language, retrieval_query, source_title, transcript, unique_sources, validate
from quernstone.operators.search import Index, relative_cut, search
from quernstone.sources.stored import new_path, stored

CITED = "start_index: double, end_index: double, title: string, url: string"
RESPONSE = (
    "output_text string, output array<struct<type: string, action: struct<sources: array<struct<title: string, url: string>>>, "
    f"content: array<struct<type: string, text: string, annotations: array<struct<{CITED}, url_citation: struct<{CITED}>>>>>>>"
)


def trimmed(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s ﻿]+|[\s ﻿]+$", "")


def chosen_attempts(attempts: DataFrame, most: int = 2) -> DataFrame:
    """request_id, attempt, status, body: of ``attempts`` the first that is neither refused for load (429) nor broken (500 and up), of ``most``; else the last of these."""
    rows = attempts.where(F.col("attempt").between(1, most))
    done = (F.col("status") != 429) & (F.col("status") < 500)
    whole = F.struct("attempt", "status", "body")
    first = F.min(F.when(done, whole))
    return rows.groupBy("request_id").agg(F.coalesce(first, F.max(whole)).alias("c")).select("request_id", "c.*")


def parsed(responses: DataFrame) -> DataFrame:
    """``responses`` (body; other columns stay) with data: the body read by schema, null if it can't be."""
    return responses.withColumn("data", F.from_json("body", RESPONSE, {"mode": "PERMISSIVE"}))


def text_parts(data: Column) -> Column:
    """array of (text, annotations): the parts of a response that are output text, in order."""
    content = F.flatten(F.transform(F.filter(data["output"], lambda x: x["content"].isNotNull()), lambda x: x["content"]))
    return F.filter(F.coalesce(content, F.array()), lambda c: F.coalesce((c["type"] == "output_text") & c["text"].isNotNull(), F.lit(False)))


def output_text(data: Column) -> Column:
    """The response's own text if there is any, else its parts joined as paragraphs; without marks of citations and formats."""
    parts = F.filter(F.transform(text_parts(data), lambda c: trimmed(c["text"])), lambda t: t != "")
    own = trimmed(data["output_text"])
    return clean_output(F.when(own != "", own).otherwise(F.array_join(parts, "\n\n")))


def paragraph_rows(texts: DataFrame, key: list[str]) -> DataFrame:
    """(key, paragraph, start, end, text) of ``texts`` (key, text): stretches between blank lines, by code points, end exclusive."""
    piece = r"(?s)(\n[ \t]*(?=\n)|\S.*?(?=\n[ \t]*\n|$(?!\n))|\s)"
    p = texts.select(*key, F.posexplode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(piece), F.lit(1))).alias("_at", "text"))
    order = Window.partitionBy(*key).orderBy("_at")
    p = p.withColumn("end", F.sum(F.length("text")).over(order)).withColumn("start", F.col("end") - F.length("text")).where(F.col("text").rlike(r"^\S"))
    return p.withColumn("paragraph", (F.row_number().over(order) - 1).cast("long")).select(*key, "paragraph", "start", "end", "text")


def aligned(paragraphs: DataFrame, annotations: DataFrame, key: list[str], width: int = 2000) -> DataFrame:
    """(key, paragraph, and all of ``annotations``): each annotation (start_index, end_index) with the paragraphs (start, end) it belongs to.

    It belongs to those it overlaps; without an end, to the one that holds its start. Both go to the stretches of ``width`` characters they
    cover and meet there; a pair that meets in several is kept in the first of them. An annotation over the whole of a long text goes to as many
    stretches as the text has.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / width), F.greatest(F.floor(b / width), F.floor(a / width)))).alias("_bin")
    p = paragraphs.select(*key, "paragraph", "start", "end", bins(F.col("start"), F.col("end") - 1))
    # an end no later than the start still belongs to the paragraph that holds both
    low = F.greatest(F.least(F.col("start_index"), F.coalesce(F.col("end_index") - 1, F.col("start_index"))), F.lit(0))
    high = F.coalesce(F.greatest(F.col("end_index") - 1, low), low)
    a = annotations.where("start_index is not null and coalesce(end_index, 1) > 0").withColumn("_low", F.floor(low / width)).select("*", bins(low, high))
    tail = F.when(F.col("end_index").isNotNull(), F.col("end_index") > F.col("start")).otherwise(F.col("start_index") >= F.col("start"))
    met = a.join(p, [*key, "_bin"]).where((F.col("start_index") < F.col("end")) & tail & (F.col("_bin") == F.greatest("_low", F.floor(F.col("start") / width))))
    return met.select("paragraph", *annotations.columns)


def section_rows(responses: DataFrame, domains: tuple[str, ...] = OFFICIAL_DOMAINS) -> DataFrame:
    """request_id, section, text, sources (array of title, url) of parsed ``responses`` (request_id, data)."""
    part = responses.select("request_id", F.posexplode(text_parts(F.col("data"))).alias("part", "c"))
    key = ["request_id", "part"]
    paragraphs = paragraph_rows(part.select(*key, F.col("c.text").alias("text")), key)
    one = part.select(*key, F.posexplode("c.annotations").alias("at", "a"))
    unwrapped = one.select(*key, "at", F.coalesce(F.col("a.url_citation"), F.struct("a.start_index", "a.end_index", "a.title", "a.url")).alias("a")).select(*key, "at", "a.*").where("url <> ''")
    cited = aligned(paragraphs, unwrapped, key).withColumn("title", F.coalesce(F.nullif("title", F.lit("")), F.lit("USCIS")))
    own = unique_sources(cited, [*key, "paragraph"], "at", domains).withColumn("title", source_title(F.col("url"), F.col("title")))
    own = own.groupBy(*key, "paragraph").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_rank", "title", "url"))), lambda x: F.struct(x["title"], x["url"])).alias("sources"))
    text = paragraphs.select(*key, "paragraph", clean_output(F.col("text")).alias("text")).where("text <> ''")
    none = F.array().cast("array<struct<title: string, url: string>>")
    order = Window.partitionBy("request_id").orderBy("part", "paragraph")
    joined = text.join(own, [*key, "paragraph"], "left").withColumn("section", (F.row_number().over(order) - 1).cast("long"))
    return joined.select("request_id", "section", "text", F.coalesce(F.col("sources").cast("array<struct<title: string, url: string>>"), none).alias("sources"))


def web_sources(responses: DataFrame) -> DataFrame:
    """request_id, at, title, url: what parsed ``responses`` cite and what their searches have read, in order."""
    item = responses.select("request_id", F.posexplode("data.output").alias("i", "x"))
    read = item.select("request_id", "i", F.lit(1).alias("k"), F.lit(0).alias("j"), F.posexplode("x.action.sources").alias("n", "s")).select("request_id", "i", "k", "j", "n", "s.title", "s.url")
    content = item.select("request_id", "i", F.posexplode("x.content").alias("j", "c"))
    cited = content.select("request_id", "i", F.lit(0).alias("k"), "j", F.posexplode("c.annotations").alias("n", "a")).select("request_id", "i", "k", "j", "n", F.coalesce(F.col("a.url_citation"), F.struct("a.start_index", "a.end_index", "a.title", "a.url")).alias("a"))
    both = cited.select("request_id", "i", "k", "j", "n", F.col("a.title").alias("title"), F.col("a.url").alias("url")).unionByName(read).where("url <> ''")
    return both.select("request_id", F.struct("i", "k", "j", "n").alias("at"), F.coalesce(F.nullif("title", F.lit("")), F.lit("USCIS")).alias("title"), "url")


def _listed(sources: DataFrame, domains: tuple[str, ...], name: str) -> DataFrame:
    """request_id and ``name``: the official sources (request_id, at, title, url) once each, in order, as an array."""
    best = unique_sources(sources, ["request_id"], "at", domains).withColumn("title", source_title(F.col("url"), F.col("title")))
    return best.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_rank", "title", "url"))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias(name))


def answer_requests(requests: DataFrame, hits: DataFrame, attempts: DataFrame, domains: tuple[str, ...] = OFFICIAL_DOMAINS, params: AnswerParams = AnswerParams()) -> DataFrame:
    """From requests to answers: request_id, status, error, output_text, sections, sources, grounded_on, degraded.

    ``requests``: request_id, question, conversation, checklist_context, language; ``hits``: the passages retrieved for each (query_id, rank, score,
    title, url, excerpt); ``attempts``: what a model returned (request_id, attempt, status, body), none where none was asked. A request that the guards refuse has an error
    only. A good response gives the text; its sources are those of its sections, else those of its searches, else the supporting passages.
    Otherwise the answer is made from the best passage and marked degraded.
    """
    r = validate(requests)
    ok = r.where("error is null")
    local = local_answer(ok.select(F.col("request_id").alias("query_id"), "question", "language"), hits, params).select(F.col("query_id").alias("request_id"), F.col("output_text").alias("own_text"), F.col("grounded_on").alias("own_ground"))
    asked = parsed(chosen_attempts(attempts).join(ok.select("request_id"), "request_id", "left_semi"))
    said = asked.withColumn("said", output_text(F.col("data"))).where(F.col("status").between(200, 299) & (F.col("said") != ""))
    rows = section_rows(said, domains)
    each = rows.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("section", "text", "sources"))), lambda x: F.struct(x["text"].alias("text"), x["sources"].alias("sources"))).alias("parts"))
    of_sections = rows.select("request_id", "section", F.posexplode("sources").alias("n", "s")).select("request_id", F.struct("section", "n").alias("at"), "s.title", "s.url")
    near = relative_cut(hits, params.relative_cut, params.supporting).select(F.col("query_id").alias("request_id"), F.col("rank").alias("at"), "title", "url")
    first = hits.where("rank = 1").select(F.col("query_id").alias("request_id"), F.col("rank").alias("at"), "title", "url")
    a = r.select("request_id", "status", "error").join(local, "request_id", "left").join(said.select("request_id", "said"), "request_id", "left").join(each, "request_id", "left")
    for sources, name in ((of_sections, "cited"), (web_sources(said), "web"), (near, "near"), (first, "first")):
        a = a.join(_listed(sources, domains, name), "request_id", "left")
    none = F.array().cast("array<struct<title: string, url: string>>")
    live, good = F.coalesce("cited", "web"), F.col("said").isNotNull()
    text = F.when(good, F.col("said")).otherwise(F.col("own_text"))
    sources = F.when(good, F.coalesce(live, F.col("near"), none)).when(F.col("error").isNull(), F.coalesce(F.col("first"), none))
    whole = F.when(F.col("error").isNull(), F.array(F.struct(text.alias("text"), sources.alias("sources"))))
    ground = F.when(good, F.when(live.isNotNull(), "live_official_sources").otherwise("local_corpus")).otherwise(F.col("own_ground"))
    return a.select("request_id", "status", "error", text.alias("output_text"), F.when(good, F.coalesce("parts", whole)).otherwise(whole).alias("sections"), sources.alias("sources"), ground.alias("grounded_on"), F.when(F.col("error").isNull(), ~good).alias("degraded"))


def ask(index: Index, turns: DataFrame, attempts: DataFrame | None = None, topics: list[Topic] = (), rules: list[tuple[tuple[str, ...], str]] = (), domains: tuple[str, ...] = OFFICIAL_DOMAINS, k: int = 8, page: str = "url", languages: tuple[str, ...] = ("en",), model: str = "m", store: str = "no-vector", params: AnswerParams = AnswerParams()) -> DataFrame:
    """The last question of each conversation, from guard to profile: request_id (the conversation), and what ``answer_requests`` gives, with
    cache_key (empty if the answer depends on more than the question), followups and answer_profile.

    ``turns``: conv_id, turn, role, text, and perhaps language and checklist_context (of the last question's row). A short or referring question is searched with the one before it.
    """
    none = F.lit("")
    has = lambda c: F.col(c) if c in turns.columns else F.lit(None).cast("string")
    last = last_user_turns(turns)
    own = turns.select("conv_id", "turn", has("language").alias("language"), has("checklist_context").alias("checklist_context"))
    before = transcript(turns.join(last.select("conv_id", F.col("turn").alias("_last")), "conv_id").where(F.col("turn") < F.col("_last")).drop("_last"))
    q = last.join(own, ["conv_id", "turn"]).join(before, "conv_id", "left").withColumnRenamed("conv_id", "request_id").dropDuplicates(["request_id"])
    q = q.withColumn("language", resolve_language(F.col("language"), languages)).withColumn("checklist_context", F.coalesce("checklist_context", none))
    q = stored(q.withColumn("conversation", F.coalesce("transcript", none)), new_path(turns.sparkSession, "asked"))
    good = validate(q).where("error is null")
    hits = stored(search(index, good.select(F.col("request_id").alias("query_id"), retrieval_query(F.col("question"), F.col("previous"), params).alias("text")), k, topics, page=page), new_path(turns.sparkSession, "hits"))
    if attempts is None:
        attempts = turns.sparkSession.createDataFrame([], "attempt int, status int, body string").join(q.select("request_id").limit(0), how="cross")
    answers = answer_requests(q, hits, attempts, domains, params)
    found = hits.groupBy(F.col("query_id").alias("request_id")).agg(F.count("*").cast("int").alias("n"))
    alone = cacheable(F.col("checklist_context"), F.col("has_prior_different"))
    key = F.when(alone, cache_key(F.col("question"), F.col("language"), F.lit(model), F.lit(store), params)).otherwise("")
    a = answers.join(q.select("request_id", "question", "language", key.alias("cache_key")), "request_id").join(found, "request_id", "left")
    text = F.array_join(F.transform("sources", lambda s: F.concat_ws(" ", s["title"], s["url"])), " ")
    profile = F.struct(
        "language",
        F.size("sources").alias("source_count"),
        F.coalesce("n", F.lit(0)).alias("retrieval_count"),
        F.coalesce("grounded_on", F.lit("unknown")).alias("grounded_on"),
        F.lit(False).alias("cached"),
        F.coalesce("degraded", F.lit(False)).alias("degraded"),
    )
    ok = F.col("error").isNull()
    follow = F.split(follow_ups(normalize_routing(F.col("question")), text, list(rules), {}, "next,documents,official"), ",")
    return a.select(*answers.columns, F.when(ok, F.col("cache_key")).alias("cache_key"), F.when(ok, follow).alias("followups"), F.when(ok, profile).alias("answer_profile"))
