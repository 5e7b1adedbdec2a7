"""The registered queries over the tables of a scale-factor folder. Their DuckDB SQL is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.config import CacheParams, ChunkParams, LimiterParams, QuotaParams, Topic, UrlRules
from quernstone.functions import text as T
from quernstone.functions import urls as U
from quernstone.operators import answer, checklist, corpus, intent, phrases, responses, search, tasks, trees
from quernstone.plans import oracle
from quernstone.plans.dims import DOMAINS, FIXED_QUERIES, FLOW_STEPS, FLOWS, FOLLOW_UPS, INTENTS, LABELS, LINKS, PAGE_QUERY, STEP_PARTS, STEPS, TASKS, TOPIC_PHRASES, TOPICS, VISITOR
from quernstone.sources.stored import new_path
from quernstone.streaming import answers, crawl, limits

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    _FOUND[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One passage per document; the source stands for the page."""
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_ord"), F.lit(0).alias("chunk_index"), F.col("source").alias("url"), none.alias("title"), none.alias("description"), "text")


def split_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as they go into a search index of answers: long ones in overlapping passages."""
    none = F.lit(None).cast("string")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_ord"), F.col("source").alias("url"), none.alias("title"), none.alias("description"), F.lit(None).cast("array<string>").alias("chunks"), "text")
    return corpus.to_passages(d)


def fixed_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIXED_QUERIES, "query_id long, text string")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role = 'user'")


# --- text and index ----------------------------------------------------------------------------------------------


@query
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("normalized"))


@query
def token_stems(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query
def term_frequency(spark, sf_dir):
    return search.build_index(doc_passages(spark, sf_dir)).term_counts.select(F.col("page_ord").alias("doc_id"), "term", F.col("tf").cast("long").alias("tf"))


@query
def document_frequency(spark, sf_dir):
    return search.build_index(doc_passages(spark, sf_dir)).term_df


@query
def corpus_stats(spark, sf_dir):
    return search.build_index(doc_passages(spark, sf_dir)).stats.select("n", F.round("avg_length", 6).alias("avg_length"), "page_count")


def _ranked(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("page_ord").alias("doc_id"), "score")


@query
def bm25_topk(spark, sf_dir):
    index = search.build_index(doc_passages(spark, sf_dir))
    return _ranked(search.rank(index, fixed_queries(spark), 10, page="page_ord"))


def flagship(spark, sf_dir):
    return bm25_topk(spark, sf_dir)


@query
def bm25_page_cap(spark, sf_dir):
    return _ranked(search.rank(search.build_index(doc_passages(spark, sf_dir)), fixed_queries(spark), 20))


@query
def bm25_phrase_path_boost(spark, sf_dir):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page_ord"), F.lit(0).alias("chunk_index"), "url", title.alias("title"), F.lit(None).cast("string").alias("description"), title.alias("text"))
    topics = [Topic("page", (PAGE_QUERY.split()[0],), (), ("/de/",))]
    asked = spark.createDataFrame([(0, PAGE_QUERY)], "query_id long, text string")
    return _ranked(search.rank(search.build_index(pages), asked, 20, topics, page="page_ord")).withColumnRenamed("doc_id", "page_id")


@query
def topic_expansion(spark, sf_dir):
    turns = user_turns(spark, sf_dir).withColumn("query_id", F.struct("conv_id", "turn"))
    return search.analyze_queries(turns, TOPICS).select("query_id.conv_id", "query_id.turn", F.array_join("terms", " ").alias("terms"), F.array_join("paths", " ").alias("paths"))


@query
def batch_search(spark, sf_dir):
    turns = user_turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return _ranked(search.rank(search.build_index(doc_passages(spark, sf_dir)), turns, 3, TOPICS))


@query
def relative_cut(spark, sf_dir):
    index = search.build_index(doc_passages(spark, sf_dir))
    return _ranked(search.relative_cut(search.rank(index, fixed_queries(spark), 10, page="page_ord")))


# --- chunks and pages --------------------------------------------------------------------------------------------


@query
def split_oversized(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(corpus.split_oversized(F.col("text"))).alias("part", "text"))
    return d.select("doc_id", F.col("part").cast("long").alias("part"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


@query
def pack_paragraphs(spark, sf_dir):
    lines = ChunkParams(separator="\n+", joiner="\n")
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(corpus.pack_paragraphs(F.col("text"), lines)).alias("part", "text"))
    return d.select("doc_id", F.col("part").cast("long").alias("part"), F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("md5"))


@query
def html_extract(spark, sf_dir):
    return corpus.extract_pages(table(spark, sf_dir, "pages"), keep=("page_id",)).select("page_id", "title", "text", F.size("chunks").cast("long").alias("n_chunks"))


@query
def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalize_url(F.col("url"), U.origin(F.col("url"))).alias("normalized"), U.host(F.col("url")).alias("host"))


SYNTHETIC_RULES = UrlRules(include_prefixes=("/en", "/de"), include_exact=("/fr",), exclude_exact=("/en/1",), exclude_prefixes=("/en/2",), exclude_extensions=("html",))


@query
def url_relevance(spark, sf_dir):
    """The rules on each page's path, put on the rules' own origin."""
    on_origin = F.concat(F.lit(SYNTHETIC_RULES.origin), U.path(F.col("url")))
    return table(spark, sf_dir, "pages").select("page_id", U.is_relevant(on_origin, SYNTHETIC_RULES, ("/de/9",)).alias("relevant"))


def _found_pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://[^/]*/([a-z]*)", 1).alias("last_modified"))
    return corpus.last_wins(p, "url", "page_id")


@query
def incremental_pending(spark, sf_dir):
    """Cached: the https pages, as they were when all were English."""
    found = _found_pages(spark, sf_dir)
    cached = found.where(F.col("url").startswith("https:")).select("url", F.lit("en").alias("last_modified"))
    return corpus.pending(found, cached).select("page_id", "url", "last_modified")


@query
def corpus_merge(spark, sf_dir):
    """Cached: https pages; fetched: those of ``.org`` hosts; approved: all but French ones."""
    found = _found_pages(spark, sf_dir)
    cached = found.where(F.col("url").startswith("https:")).select("url", F.lit("old").alias("state"))
    fetched = found.where(F.col("url").rlike("://[^/]*[.]org(/|$)")).select("url", F.lit("new").alias("state"))
    return corpus.merge(cached, fetched, found.where("last_modified <> 'fr'"))


@query
def dedupe_last_wins(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", U.host(F.col("url")).alias("host"), "url")
    return corpus.last_wins(p, "host", "page_id")


@query
def source_dedup(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("").alias("title"), F.regexp_extract("url", "://[^/]*/([a-z]*)", 1).alias("lang"))
    return answer.unique_sources(p, ["lang"], "page_id", DOMAINS).select("lang", "url", "page_id", F.col("source_rank").cast("long").alias("source_rank"))


# --- questions and conversations ---------------------------------------------------------------------------------


@query
def pii_guard(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[answer.sensitive(F.col("text"), k).alias(k) for k in answer.SENSITIVE_PATTERNS])


@query
def request_validation(spark, sf_dir):
    """Every turn as a request, its text as question."""
    r = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("question"), F.lit("").alias("conversation"), F.lit("").alias("checklist_context"), F.lit("en").alias("language"))
    return answer.validate(r).select("conv_id", "turn", F.col("status").cast("long").alias("status"), "error")


@query
def last_user_turn(spark, sf_dir):
    return answer.last_user_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "question")


@query
def prior_different_question(spark, sf_dir):
    return answer.last_user_turns(table(spark, sf_dir, "conversations")).select("conv_id", "has_prior_different")


@query
def retrieval_query(spark, sf_dir):
    t = answer.last_user_turns(table(spark, sf_dir, "conversations"))
    return t.select("conv_id", answer.retrieval_query(F.col("question"), F.col("previous")).alias("query"))


@query
def transcript_last8(spark, sf_dir):
    return answer.transcript(table(spark, sf_dir, "conversations"))


@query
def intent_scores(spark, sf_dir):
    return intent.intent_scores(user_turns(spark, sf_dir), INTENTS).select("conv_id", "turn", *[F.col(n).cast("long").alias(n) for n in INTENTS])


@query
def topic_argmax(spark, sf_dir):
    return intent.best_topic(user_turns(spark, sf_dir), TOPIC_PHRASES).select("conv_id", "turn", "topic", "topic_score")


@query
def flow_match(spark, sf_dir):
    return intent.flow_match(user_turns(spark, sf_dir), FLOWS).select("conv_id", "turn", "flow_id")


@query
def followup_rules(spark, sf_dir):
    t = user_turns(spark, sf_dir).withColumn("plain", T.normalize_routing(F.col("text")))
    return t.select("conv_id", "turn", intent.first_rule(F.col("plain"), FOLLOW_UPS, "next,documents,official").alias("followups"))


@query
def domain_routing(spark, sf_dir):
    t = user_turns(spark, sf_dir).withColumn("plain", T.normalize_routing(F.col("text")))
    return t.select("conv_id", "turn", F.array_join(answer.domains_for(F.col("plain"), VISITOR), ",").alias("domains"))


@query
def useful_sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("excerpt"), F.lit(FIXED_QUERIES[0][1]).alias("question"))
    return answer.useful_sentences(d).select("doc_id", "passage")


@query
def extractive_answer(spark, sf_dir):
    turns = user_turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    hits = search.search(search.build_index(split_passages(spark, sf_dir)), turns, 1, TOPICS)
    return answer.local_answer(turns.select("query_id", F.col("text").alias("question"), F.lit("en").alias("language")), hits)


@query
def local_context(spark, sf_dir):
    hits = search.search(search.build_index(doc_passages(spark, sf_dir)), fixed_queries(spark), 3, page="page_ord")
    return answer.local_context(hits.withColumn("last_modified", F.lit(None).cast("string"))).select("query_id", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("md5"))


@query
def answer_cache_keys(spark, sf_dir):
    """The key under which a conversation's last question may be cached; empty if the answer depends on more than it."""
    t = answer.last_user_turns(table(spark, sf_dir, "conversations"))
    alone = answer.cacheable(F.when(F.col("conv_id") % 3 == 0, "a list").otherwise(" "), F.col("has_prior_different"))
    key = answer.cache_key(F.col("question"), F.lit("en"), F.lit("m"), F.lit("no-vector"))
    return t.select("conv_id", alone.alias("cacheable"), F.when(alone, key).otherwise("").alias("key"))


@query
def answer_profiles(spark, sf_dir):
    """Each language's pages as the retrieved passages of one answer, which cites them all."""
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.lit("").alias("title"), F.regexp_extract("url", "://[^/]*/([a-z]*)", 1).alias("answer_id"))
    answers = p.select("answer_id").distinct().withColumns({"grounded_on": F.lit(None).cast("string"), "language": F.col("answer_id"), "cached": F.lit(False), "degraded": F.col("answer_id") == "fr"})
    rules = [(("es",), "fees,forms,next"), (("de",), "documents,official,next")]
    found = answer.with_metadata(answers, answer.unique_sources(p, ["answer_id"], "page_id", DOMAINS), p, answer.follow_ups(F.col("answer_id"), F.array_join("sources.url", " "), rules, {1: ("example.org",)}, "next,documents,official"))
    profile = [F.col(f"answer_profile.{c}").cast("long").alias(c) for c in ("source_count", "retrieval_count")]
    return found.select("answer_id", *profile, "answer_profile.degraded", "answer_profile.grounded_on", F.array_join("followups", ",").alias("followups"))


@query
def citation_alignment(spark, sf_dir):
    """Each document as an answer with three marks at fixed offsets."""
    marks = F.array(*[F.struct(F.lit(s).alias("start_index"), F.lit(e).cast("int").alias("end_index"), F.lit(u).alias("url")) for s, e, u in ((0, 10, "a"), (150, 400, "b"), (300, None, "c"))])
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("answer_id"), F.regexp_replace("text", "\n", "\n\n").alias("text"), marks.alias("annotations"))
    s = answer.sections(d)
    return s.select("answer_id", *[F.col(c).cast("long").alias(c) for c in ("paragraph", "start", "end")], F.array_join("cited", ",").alias("cited"))


@query
def annotation_join(spark, sf_dir):
    """Each document as an answer with a mark at every 97th character, every third without an end."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    at = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(97))
    marks = d.select("doc_id", F.posexplode(at).alias("n", "start_index")).withColumn("end_index", F.when(F.col("n") % 3 != 2, F.col("start_index") + 150))
    met = responses.aligned(responses.paragraph_rows(d, ["doc_id"]), marks, ["doc_id"])
    return met.groupBy("doc_id", "paragraph").agg(F.count("*").alias("marks"), F.min("start_index").cast("long").alias("first"), F.max("start_index").cast("long").alias("last"))


@query
def model_answers(spark, sf_dir):
    """User turns as requests; the assistant's next turn as a model's response in two parts, some attempts refused, broken or not to be read."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = table(spark, sf_dir, "conversations").withColumns({"reply": F.lead("text").over(w), "by": F.lead("role").over(w)}).where("role = 'user'")
    t = t.withColumn("request_id", F.col("conv_id") * 1000 + F.col("turn"))
    requests = t.select("request_id", F.col("text").alias("question"), F.lit("").alias("conversation"), F.lit("").alias("checklist_context"), F.lit("en").alias("language"))
    url = F.concat(F.lit("https://www.example.com/p/"), F.col("conv_id").cast("string"), F.lit("?utm=1"))
    mark = F.struct(F.lit(0).alias("start_index"), F.lit(10).alias("end_index"), F.lit("Page").alias("title"), F.when(F.col("conv_id") % 4 > 0, url).alias("url"))
    say = lambda text, marks: F.struct(F.lit("output_text").alias("type"), text.alias("text"), marks.alias("annotations"))
    wrapped = F.array(F.struct(mark.alias("url_citation")))
    content = F.array(say(F.col("reply"), wrapped), say(F.concat(F.lit(" See **page** "), F.col("conv_id").cast("string"), F.lit(" .\n\nEnd ")), F.array().cast(f"array<struct<url_citation: struct<{'start_index: int, end_index: int, title: string, url: string'}>>>")))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("message").alias("type"), content.alias("content"))).alias("output")))
    replied = t.where("by = 'assistant'").select("request_id", "conv_id", body.alias("body"))
    first = replied.select("request_id", F.lit(1).alias("attempt"), F.when(F.col("conv_id") % 5 == 0, 503).when(F.col("conv_id") % 5 == 1, 400).otherwise(200).alias("status"), F.when(F.col("conv_id") % 7 == 0, "{").otherwise(F.col("body")).alias("body"))
    second = replied.where("conv_id % 5 = 0").select("request_id", F.lit(2).alias("attempt"), F.when(F.col("conv_id") % 10 == 0, 200).otherwise(429).alias("status"), "body")
    hits = spark.createDataFrame([], "query_id long, rank int, score double, title string, url string, excerpt string")
    a = responses.answer_requests(requests, hits, first.unionByName(second), DOMAINS)
    return a.select("request_id", F.col("status").cast("long").alias("status"), "error", "output_text", F.size("sections").cast("long").alias("n_sections"), F.array_join("sources.url", " ").alias("sources"), "grounded_on", "degraded")


@query
def ask_conversations(spark, sf_dir):
    """The last question of each conversation to the pages, by their titles; no model is asked."""
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page_ord"), F.lit(0).alias("chunk_index"), "url", title.alias("title"), F.lit(None).cast("string").alias("description"), title.alias("text"))
    a = responses.ask(search.build_index(pages), table(spark, sf_dir, "conversations"), rules=FOLLOW_UPS, domains=DOMAINS, page="page_ord")
    profile = [F.col(f"answer_profile.{c}").cast("long").alias(c) for c in ("source_count", "retrieval_count")]
    return a.select(F.col("request_id").alias("conv_id"), F.col("status").cast("long").alias("status"), "error", "output_text", "grounded_on", "degraded", F.array_join("sources.url", " ").alias("sources"), "cache_key", F.array_join("followups", ",").alias("followups"), *profile)


@query
def section_sources(spark, sf_dir):
    """Each page's address cited in every paragraph of a short answer."""
    marks = F.array(*[F.struct(F.lit(s).alias("start_index"), F.lit(e).alias("end_index"), F.col("url").alias("url")) for s, e in ((0, 3), (4, 9))])
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("answer_id"), F.lit("one\n\ntwo three").alias("text"), marks.alias("annotations"))
    found = answer.section_sources(answer.sections(p), DOMAINS)
    return found.select("answer_id", F.col("paragraph").cast("long").alias("paragraph"), "url", "title", F.col("source_rank").cast("long").alias("source_rank"))


# --- phrases of a large table ------------------------------------------------------------------------------------


def _item_grams(spark, sf_dir, *sizes: int) -> DataFrame:
    """Each benchmark item's runs of words, as phrases that name it."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.split(T.normalize_intent(F.col("text")), " ").alias("w"))
    return w.select("item_id", F.explode(phrases.word_grams(F.col("w"), list(sizes))).alias("phrase"))


@query
def phrase_intents(spark, sf_dir):
    """Runs of one to four words of the benchmark items as terms of as many intents: thousands of phrases."""
    terms = _item_grams(spark, sf_dir, 1, 2, 3, 4).select(F.col("item_id").alias("intent"), F.col("phrase").alias("term"))
    return phrases.intent_scores(user_turns(spark, sf_dir), ["conv_id", "turn"], terms).select("conv_id", "turn", F.col("intent").alias("item_id"), F.col("score").cast("long").alias("score"))


@query
def phrase_expansion(spark, sf_dir):
    """Each benchmark item as a topic that its runs of two words name."""
    grams = _item_grams(spark, sf_dir, 2).groupBy("item_id").agg(F.collect_list("phrase").alias("phrases"))
    name = F.col("item_id").cast("string")
    topics = grams.select(F.col("item_id").alias("topic_ord"), "phrases", F.array(F.concat(F.lit("topic"), name)).alias("terms"), F.array(F.concat(F.lit("/item/"), name)).alias("paths"))
    asked = user_turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return phrases.expand_queries(asked, topics).select("query_id", F.array_join("terms", " ").alias("terms"), F.array_join("paths", " ").alias("paths"))


@query
def phrase_best_topic(spark, sf_dir):
    """Each benchmark item as a topic, its sentences as phrases."""
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("topic_ord"), F.col("item_id").cast("string").alias("topic"), F.explode(F.split("text", "[.]")).alias("phrase"))
    return phrases.best_topic(user_turns(spark, sf_dir), ["conv_id", "turn"], t)


# --- commands ----------------------------------------------------------------------------------------------------


@query
def task_action(spark, sf_dir):
    t = intent.intent_scores(intent.flow_match(user_turns(spark, sf_dir), FLOWS), TASKS)
    plain = T.normalize_intent(F.col("text"))
    step = F.when(plain.contains("der"), "step")
    action = tasks.task_action(F.col("text"), plain, {k: F.col(k) for k in TASKS}, F.col("flow_id"), step, F.col("conv_id") % 4 != 0)
    return t.select("conv_id", "turn", action.alias("action"))


@query
def official_link(spark, sf_dir):
    return user_turns(spark, sf_dir).select("conv_id", "turn", tasks.first_intent(T.normalize_intent(F.col("text")), LINKS, "https://example.com").alias("url"))


@query
def step_match(spark, sf_dir):
    steps = spark.createDataFrame(STEP_PARTS, "flow_id string, step_ord long, step_id string, parts array<string>")
    asked = user_turns(spark, sf_dir).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.lit("first").alias("flow_id"), "text")
    return intent.find_step(asked, steps).select("query_id", "step_id", F.round("score", 4).alias("score"))


@query
def reminder_times(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("due"), F.explode(F.array(*map(F.lit, (30, 14, 7, 0)))).alias("days"))
    now = F.lit("1997-01-01 09:00:00").cast("timestamp")
    at = tasks.reminder_time(F.col("due"), F.col("days"))
    return o.select("o_orderkey", F.col("days").cast("long").alias("days"), F.date_format(at, "yyyy-MM-dd HH:mm").alias("fires"), tasks.reminder_status(F.col("due"), F.col("days"), now).alias("status"))


@query
def date_parts(spark, sf_dir):
    y, m = F.year("o_orderdate"), F.month("o_orderdate")
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", tasks.days_in_month(y, m).cast("long").alias("days"), tasks.clamped_day(y, m, F.lit(31)).cast("long").alias("last"), F.array_join(tasks.year_choices(y), ",").alias("years"))


@query
def shared_contexts(spark, sf_dir):
    """Consent, sharing and error texts over the events, their type standing for an error code."""
    e = table(spark, sf_dir, "events")
    given = tasks.consent_given(F.col("user_id") % 2 == 0, F.col("event_id") % 3)
    context = tasks.shared_context(F.col("event_type"), given, F.col("event_id") % 2 == 0)
    error = tasks.error_message(F.when(F.col("event_id") % 5 == 0, 429).otherwise(500), F.when(F.col("event_type") == "error", "sensitive_identifier"), F.when(F.col("event_id") % 7 == 0, F.col("event_type")))
    return e.select("event_id", given.alias("given"), context.alias("context"), error.alias("error"))


# --- state, checklists, quality ----------------------------------------------------------------------------------


@query
def rate_limit(spark, sf_dir):
    return limits.admit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", LimiterParams(3, 86_400))


@query
def rate_limit_stream(spark, sf_dir):
    """The events as a stream of files, and one far event that lets the watermark pass all others; as ``rate_limit``."""
    at = new_path(spark, "limiter")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    last = spark.range(1).select(F.lit(None).cast("long").alias("client"), F.col("id").alias("event_id"), F.lit("2200-01-01").cast("timestamp").alias("at"))
    last.write.parquet(f"{at}/last/end")
    end = spark.readStream.schema(last.schema).parquet(f"{at}/last/*")
    rows = events.select(F.col("user_id").alias("client"), "event_id", F.col("ts").cast("timestamp").alias("at")).unionByName(end)
    done = limits.run_to_end(limits.admit_stream(rows, LimiterParams(3, 86_400)), at)
    return done.where("client is not null").select(F.col("client").alias("user_id"), "event_id", "admitted")


@query
def answer_replay(spark, sf_dir):
    """User turns as requests one second apart, the turn that follows each as its answer; only its text's form is shown."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").withColumn("answer", F.lead("text").over(w)).where("role = 'user'")
    request = F.col("conv_id") * 1000 + F.col("turn")
    key = F.when(F.col("conv_id") % 7 > 0, answer.cache_key(F.col("text"), F.lit("en"), F.lit("m"), F.lit("no-vector")))
    done = answers.replay(turns.select(request.alias("request_id"), key.alias("cache_key"), F.timestamp_seconds(request).alias("at"), "answer"), CacheParams(ttl_seconds=200_000))
    return done.select("request_id", "hit", F.md5("answer").alias("answer"))


@query
def cache_ttl_hits(spark, sf_dir):
    return limits.cache_hits(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", CacheParams(ttl_seconds=86_400))


@query
def monthly_quota(spark, sf_dir):
    return limits.monthly_quota(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", QuotaParams(5)).withColumn("used", F.col("used").cast("long"))


@query
def answered_quota(spark, sf_dir):
    """Events as questions: those of type error got no answer, every fourth user has the plan."""
    e = table(spark, sf_dir, "events").withColumns({"answered": F.col("event_type") != "error", "plus": F.col("user_id") % 4 == 0})
    return limits.answered_quota(e, "user_id", "ts", "event_id", "answered", "plus", QuotaParams(5)).withColumn("used", F.col("used").cast("long"))


@query
def progress_rollup(spark, sf_dir):
    steps = spark.createDataFrame([(s,) for s in STEPS], "step string")
    done = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("step"))
    return checklist.progress(steps, done, ["user_id"]).withColumn("percent", F.col("percent").cast("long"))


def _progress_lists(spark, sf_dir):
    """The event types of a user as steps done, for every customer number up to the users' and beyond."""
    steps = spark.createDataFrame(FLOW_STEPS, "flow_id string, step_ord int, step string")
    e = table(spark, sf_dir, "events").where("event_id % 3 = 0").select("user_id", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("flow_id"), F.col("event_type").alias("step"))
    return checklist.progress_lists(steps, e, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), ["user_id"])


@query
def progress_lists(spark, sf_dir):
    p = _progress_lists(spark, sf_dir)
    return p.select("user_id", "flow_id", F.col("total").cast("long").alias("total"), F.array_join("completed", ",").alias("completed"), F.array_join("remaining", ",").alias("remaining"), F.col("percent").cast("long").alias("percent"))


@query
def flow_summary(spark, sf_dir):
    due = F.when(F.col("user_id") % 2 == 0, F.lit("2024-03-01").cast("date"))
    text = checklist.flow_summary(F.col("flow_id"), F.date_format(due, "yyyy-MM-dd"), checklist.key_dates(due), LABELS)
    return _progress_lists(spark, sf_dir).select("user_id", "flow_id", text.alias("summary"))


def _catalogues(spark, sf_dir) -> DataFrame:
    """Each document as a nested catalogue of its language: source, a number, then a title with a placeholder and a list."""
    number = F.concat(F.lit("k"), (F.col("doc_id") % 13).cast("string"))
    title = F.concat(F.lit("{{n"), (F.col("n_chars") % 3).cast("string"), F.lit("}} "), F.left("text", F.lit(8)))
    entry = F.struct(title.alias("title"), F.array("lang", (F.col("doc_id") % 5).cast("string")).alias("tags"))
    d = table(spark, sf_dir, "documents")
    return trees.flat_keys(d.select("doc_id", "lang", F.to_json(F.create_map("source", F.create_map(number, entry))).alias("tree")), ["doc_id", "lang"], "tree")


def _strings(spark, sf_dir) -> DataFrame:
    """The catalogues of a language as one, of a repeated key the last document's."""
    return _catalogues(spark, sf_dir).groupBy("lang", "key_path").agg(F.max_by("value", "doc_id").alias("value"))


@query
def nested_keys(spark, sf_dir):
    return _catalogues(spark, sf_dir).select("doc_id", "key_path", "value")


@query
def localized_strings(spark, sf_dir):
    s = _strings(spark, sf_dir)
    wanted = s.select("key_path").distinct().join(F.broadcast(s.select("lang").distinct()))
    return checklist.translated(s, wanted)


@query
def discovered_pages(spark, sf_dir):
    """The pages as sitemap entries, their paths put on the rules' own origin, their language as date."""
    on_origin = F.concat(F.lit(SYNTHETIC_RULES.origin), U.path(F.col("url")))
    entries = table(spark, sf_dir, "pages").select(F.col("page_id").alias("place"), on_origin.alias("url"), F.concat(F.regexp_extract("url", "://[^/]*/([a-z]*)", 1), F.col("page_id").cast("string")).alias("last_modified"))
    return corpus.discover(entries, SYNTHETIC_RULES, ("/de/9",))


@query
def crawl_run(spark, sf_dir):
    """Cached: https pages, as they were when all were English; fetched: all, but every third without success or as another type."""
    found = _found_pages(spark, sf_dir)
    cached = found.where(F.col("url").startswith("https:")).select("url", F.lit("en").alias("last_modified"), F.lit("old").alias("html"))
    fetched = found.select("url", F.when(F.col("page_id") % 3 == 0, 404).otherwise(200).alias("status"), F.when(F.col("page_id") % 3 == 1, "text/html; charset=utf-8").when(F.col("page_id") % 3 == 2, "Text/HTML").otherwise("text/plain").alias("content_type"), F.lit("new").alias("html"))
    return corpus.crawl(found.where("last_modified <> 'fr'").select("url", "last_modified"), cached, fetched)


@query
def crawl_stream(spark, sf_dir):
    """The crawl of ``crawl_run`` as a stream of planned steps, each fetched from the pages and stored."""
    found = _found_pages(spark, sf_dir)
    cached = found.where(F.col("url").startswith("https:")).select("url", F.lit("en").alias("last_modified"), F.lit("old").alias("html"))
    site = found.select("url", F.when(F.col("page_id") % 3 == 0, 404).otherwise(200).alias("status"), F.when(F.col("page_id") % 3 == 1, "text/html; charset=utf-8").when(F.col("page_id") % 3 == 2, "Text/HTML").otherwise("text/plain").alias("content_type"), F.lit("new").alias("html"))
    approved, at = found.where("last_modified <> 'fr'").select("url", "last_modified"), new_path(spark, "crawl")
    crawl.plan(approved, cached, at)
    crawl.run(spark, at, lambda asked: asked.select("url").join(site, "url"))
    return crawl.corpus(approved, cached, at)


@query
def key_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(checklist.key_dates(F.to_date("o_orderdate"))).alias("d"))
    return o.select("o_orderkey", "d.id", "d.iso")


@query
def key_parity(spark, sf_dir):
    return checklist.key_parity(_strings(spark, sf_dir))


def queries() -> dict[str, Query]:
    return dict(_FOUND)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in oracle.sql().items() if k in _FOUND}
