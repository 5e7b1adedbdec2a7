"""From a question to an extractive answer: guards, conversation context, sentences, sources, sections.

Answers of a language model come in as a DataFrame; none is called here. Null fields count as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernstone.config import OFFICIAL_DOMAINS, SENSITIVE_PATTERNS, VISITOR_DOMAINS, AnswerParams
from quernstone.functions import urls
from quernstone.functions.text import normalize_routing, query_tokens, squeeze


#: What a text that fits a sensitive pattern has in any case. Each begins with a rare class, so a text is passed over at one look a
#: character, where the patterns themselves begin with an alternative at every place.
HINTS = {
    "a_number": r"[Aa][-\s]?[0-9]{7}",
    "receipt": r"[A-Za-z][0-9]{10}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9](?:[ -]*+[0-9]){12}",
    "passport": r"[PpRr][AaEe][SsIi][SsAa][EeAa]?[Pp](?:[Oo][Rr][Tt]|[Aa][Ss][Ss])",
}


def sensitive(text: Column, kind: str) -> Column:
    """Whether a text fits the kind's pattern, which is tried only where its hint is."""
    t = F.coalesce(text, F.lit(""))
    fits = t.rlike(SENSITIVE_PATTERNS[kind])
    return F.when(t.rlike(HINTS[kind]), fits).otherwise(False) if kind in HINTS else fits


def has_sensitive(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [sensitive(text, kind) for kind in SENSITIVE_PATTERNS])


def validate(requests: DataFrame, params: AnswerParams = AnswerParams()) -> DataFrame:
    """``requests`` (question, conversation, checklist_context, language) with trimmed fields, status and error."""
    empty = F.lit("")
    r = requests.withColumns(
        {
            "question": F.trim(F.coalesce("question", empty)),
            "conversation": F.substring(F.coalesce("conversation", empty), 1, params.max_context),
            "checklist_context": F.substring(F.coalesce("checklist_context", empty), 1, params.max_context),
            "language": F.substring(F.coalesce("language", F.lit("en")), 1, params.max_language),
        }
    )
    every = F.concat_ws("\n", "question", "conversation", "checklist_context")
    error = F.when(F.col("question") == "", "question_required").when(F.length("question") > params.max_question, "question_too_long").when(has_sensitive(every), "sensitive_identifier")
    return r.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), 200).otherwise(400))


def resolve_language(code: Column, supported: tuple[str, ...]) -> Column:
    short = F.split_part(F.lower(F.coalesce(code, F.lit("en"))), F.lit("-"), F.lit(1))
    return F.when(short.isin(list(supported)), short).otherwise("en")


# --- conversations -----------------------------------------------------------------------------------------------


def last_user_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, question, previous, has_prior_different: each conversation's last question and what came before it."""
    users = turns.where("role = 'user'").select("conv_id", "turn", F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    users = users.withColumn("plain", normalize_routing(F.col("text")))
    w = Window.partitionBy("conv_id").orderBy("turn")
    before, said = w.rowsBetween(Window.unboundedPreceding, -1), F.nullif(F.col("plain"), F.lit(""))
    both = users.withColumns({"previous": F.lag("text").over(w), "low": F.min(said).over(before), "high": F.max(said).over(before), "next": F.lead("turn").over(w)})
    # if all earlier ones are alike, the least and the greatest are that one
    other = F.coalesce((F.col("low") != F.col("plain")) | (F.col("high") != F.col("plain")), F.lit(False))
    return both.where("next is null").select("conv_id", "turn", F.col("text").alias("question"), "previous", other.alias("has_prior_different"))


def retrieval_query(question: Column, previous: Column, params: AnswerParams = AnswerParams()) -> Column:
    """A short or referring question takes the previous one along, if that differs."""
    refers = (F.size(query_tokens(question)) < params.follow_up_under) | question.rlike(r"(?i)(^|[^A-Za-z0-9_])(it|that|this|they|them|those|these)($|[^A-Za-z0-9_])")
    before = F.coalesce(previous, F.lit(""))
    return F.when(refers & (before != "") & (before != question), F.concat(question, F.lit("\nPrevious user question: "), before)).otherwise(question)


def transcript(turns: DataFrame, last: int = 8) -> DataFrame:
    """conv_id, transcript: the last messages of each conversation as lines."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = turns.where("role in ('user', 'assistant')").withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("text", F.lit("")))
    lines = kept.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    return lines.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("transcript"))


def domains_for(plain: Column, visitor_terms: tuple[str, ...]) -> Column:
    """The domains that may answer a normalised question."""
    visit = reduce(lambda a, b: a | b, [plain.contains(t) for t in visitor_terms])
    return F.when(visit, F.array(*map(F.lit, VISITOR_DOMAINS))).otherwise(F.array(*map(F.lit, OFFICIAL_DOMAINS)))


def cache_key(question: Column, language: Column, model: Column, store: Column, params: AnswerParams = AnswerParams()) -> Column:
    plain = F.substring(normalize_routing(question), 1, params.cache_chars)
    return F.when(plain == "", "").otherwise(F.concat_ws("|", F.lit("v3"), language, model, store, plain))


def cacheable(checklist_context: Column, has_prior_different: Column) -> Column:
    """Whether an answer depends on its question alone."""
    return (F.trim(F.coalesce(checklist_context, F.lit(""))) == "") & ~F.coalesce(has_prior_different, F.lit(False))


def follow_ups(plain: Column, source_text: Column, rules: list[tuple[tuple[str, ...], str]], by_source: dict[int, tuple[str, ...]], otherwise: str) -> Column:
    """The follow-up ids of the first rule that fits: a term is in the normalised question, or, for the rules that
    ``by_source`` numbers, one of its domains in the titles and URLs of the sources."""
    out = F.when(F.lit(False), "")
    for i, (terms, value) in enumerate(rules):
        hit = reduce(lambda a, b: a | b, [plain.contains(t) for t in terms] + [F.coalesce(source_text, F.lit("")).contains(d) for d in by_source.get(i, ())])
        out = out.when(hit, value)
    return out.otherwise(otherwise)


def with_metadata(answers: DataFrame, sources: DataFrame, retrieved: DataFrame, followups: Column) -> DataFrame:
    """``answers`` (answer_id, grounded_on, language, cached, degraded) with sources, followups and answer_profile.

    ``sources``: answer_id, url, title, source_rank as ``unique_sources`` gives them (a few per answer);
    ``retrieved``: answer_id, one row for each passage that was retrieved.
    """
    own = sources.groupBy("answer_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("source_rank", "url", "title"))), lambda x: F.struct(x["title"].alias("title"), x["url"].alias("url"))).alias("sources"))
    counts = retrieved.groupBy("answer_id").agg(F.count("*").alias("_n"))
    a = answers.join(own, "answer_id", "left").join(counts, "answer_id", "left")
    a = a.withColumn("sources", F.coalesce("sources", F.array().cast("array<struct<title:string,url:string>>"))).withColumn("followups", F.split(followups, ","))
    profile = F.struct(
        F.coalesce("language", F.lit("en")).alias("language"),
        F.size("sources").alias("source_count"),
        F.coalesce("_n", F.lit(0)).cast("int").alias("retrieval_count"),
        F.coalesce("grounded_on", F.lit("unknown")).alias("grounded_on"),
        F.coalesce("cached", F.lit(False)).alias("cached"),
        F.coalesce("degraded", F.lit(False)).alias("degraded"),
    )
    return a.withColumn("answer_profile", profile).drop("_n")


def known_followups(ids: Column, known: tuple[str, ...], most: int = 3) -> Column:
    """Of an answer's follow-up ids the known ones, once each, the first few."""
    return F.slice(F.array_distinct(F.filter(F.coalesce(ids, F.array().cast("array<string>")), lambda x: x.isin(list(known)))), 1, most)


def revealed_sections(text: Column, sources: Column, sections: Column) -> Column:
    """The sections to show: those with a text; else each paragraph of the text, with all sources; none without any text."""
    full = F.filter(sections, lambda s: F.trim(F.coalesce(s["text"], F.lit(""))) != "")
    edges = lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")
    cut = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\n[ \t]*\n"), edges), lambda t: t != "")
    return F.when(F.coalesce(F.size(full), F.lit(0)) > 0, full).otherwise(F.transform(cut, lambda t: F.struct(t.alias("text"), sources.alias("sources"))))


def local_context(hits: DataFrame) -> DataFrame:
    """query_id, context: the numbered passages of each query's ``hits`` (rank, title, url, last_modified, excerpt) as one text."""
    of = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    one = F.concat(F.lit("[Passage "), F.col("rank").cast("string"), F.lit("]\nTitle: "), of("title", ""), F.lit("\nURL: "), of("url", ""), F.lit("\nLast modified: "), of("last_modified", "unknown"), F.lit("\nPassage: "), of("excerpt", ""))
    lines = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("line")))).alias("l"))
    return lines.select("query_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n\n").alias("context"))


# --- extractive answers ------------------------------------------------------------------------------------------


def useful_sentences(hits: DataFrame, params: AnswerParams = AnswerParams()) -> DataFrame:
    """Adds ``passage`` to ``hits`` (excerpt, question): its best sentences for the question, in text order."""
    marked = F.regexp_replace(squeeze(F.coalesce("excerpt", F.lit(""))), r"([.!?])\s+", "$1\n")
    one = hits.withColumns({"_w": query_tokens(F.col("question")), "_s": F.split(marked, "\n")})
    fit = F.filter("_s", lambda s: F.length(s).between(params.min_sentence, params.max_sentence) & ~s.rlike("^[a-z]"))
    # tokens of all sentences in one call of the UDF: the kept sentences are joined by a sign that is no token
    one = one.withColumn("_f", fit).withColumn("_t", F.split(_spaced(F.array_join("_f", "\u001e")), "\u001e"))

    def scored(s: Column, i: Column) -> Column:
        found = F.regexp_extract_all(F.element_at("_t", i + 1), F.lit(r"[\p{L}\p{N}-]{3,}"), 0)
        n = F.size(F.filter(found, lambda x: F.array_contains("_w", x)))
        return F.struct((n * 5 - i * 0.08).alias("score"), (-i).alias("o"), s.alias("s"))

    best = F.slice(F.reverse(F.array_sort(F.transform("_f", scored))), 1, params.sentences)
    ordered = F.array_sort(F.transform(best, lambda x: F.struct((-x["o"]).alias("o"), x["s"].alias("s"))))
    short = F.substring(squeeze(F.coalesce("excerpt", F.lit(""))), 1, params.fallback_chars)
    passage = F.when(F.size("_f") > 0, F.array_join(F.transform(ordered, lambda x: x["s"]), " ")).otherwise(short)
    return one.withColumn("passage", passage).drop("_w", "_s", "_f", "_t")


def _spaced(text: Column) -> Column:
    from quernstone.functions.text import _folded

    return _folded(text, "NFKD", r"\p{M}+")


def local_answer(questions: DataFrame, hits: DataFrame, params: AnswerParams = AnswerParams()) -> DataFrame:
    """query_id, output_text, grounded_on, url: the framed best passage of each question (query_id, question, language)."""
    best = hits.where("rank = 1").select("query_id", "url", "excerpt")
    q = useful_sentences(questions.join(best, "query_id", "left"), params)
    copy = F.create_map(*[x for code, texts in params.copy.items() for x in (F.lit(code), F.create_map(*[y for k, v in texts.items() for y in (F.lit(k), F.lit(v))]))])
    own = F.coalesce(F.try_element_at(copy, F.col("language")), F.element_at(copy, F.lit("en")))
    said = lambda k: F.try_element_at(own, F.lit(k))
    text = F.concat(said("intro"), F.lit("\n\n"), F.coalesce(F.concat(said("source_language"), F.lit("\n")), F.lit("")), F.col("passage"), F.lit("\n\n"), said("verify"))
    none = F.col("excerpt").isNull()
    return q.select("query_id", F.when(none, said("missing")).otherwise(text).alias("output_text"), F.when(none, "no_matching_source").otherwise("local_corpus").alias("grounded_on"), "url")


# --- sources and sections ----------------------------------------------------------------------------------------


def unique_sources(cited: DataFrame, keys: list[str], order: str, domains: tuple[str, ...] = OFFICIAL_DOMAINS, most: int = 6) -> DataFrame:
    """Of ``cited`` (keys, order, url, title) the official pages, once each in order of first mention, at most ``most``."""
    ok = cited.where(urls.is_official(F.col("url"), domains) & ~urls.is_translated_source(F.col("url")))
    first = ok.withColumn("url", urls.canonical_source(F.col("url"))).groupBy(*keys, "url").agg(F.min(order).alias(order), F.min_by("title", order).alias("title"))
    return first.withColumn("source_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("source_rank") <= most)


#: Agency labels by domain, for sources without a title.
AGENCIES = {
    "uscis.gov": "USCIS",
    "state.gov": "U.S. Department of State",
    "cbp.gov": "U.S. Customs and Border Protection",
    "dhs.gov": "U.S. Department of Homeland Security",
    "ice.gov": "U.S. Immigration and Customs Enforcement",
    "justice.gov": "U.S. Department of Justice",
    "dol.gov": "U.S. Department of Labor",
}


def source_title(url: Column, title: Column) -> Column:
    h = urls.host(url)
    label = reduce(lambda w, kv: w.when(h.endswith(kv[0]), kv[1]), AGENCIES.items(), F.when(F.lit(False), ""))
    wrong = (title == "USCIS") & ~h.endswith("uscis.gov")
    return F.when((F.coalesce(title, F.lit("")) != "") & ~wrong, title).otherwise(label.otherwise("Official U.S. government source"))


def clean_output(text: Column) -> Column:
    """Answer prose without cite marks, markdown and stray blanks."""
    rules = [
        (r"\uE200cite[^\uE201]+\uE201", ""),
        (r"\s*\(\s*\[\s*\]\(\s*\)\s*\)", ""),
        (r"\[\s*\]\(\s*(https?://[^)]*)?\s*\)", ""),
        (r"\[([^\]]+)\]\(https?://[^)]+\)", "$1"),
        (r"(?i)\s*\(([a-z0-9-]+\.)*(uscis|state|cbp|dhs|ice|justice|dol)\.gov\)", ""),
        (r"\*\*([^*]+)\*\*", "$1"),
        (r"(?m)^#{1,6}\s+", ""),
        (r"[ \t]+([,.;:!?])", "$1"),
        (r"[ \t]+\n", "\n"),
        (r"\n{3,}", "\n\n"),
        (r"^\s+|\s+$", ""),
    ]
    return reduce(lambda t, r: F.regexp_replace(t, *r), rules, F.coalesce(text, F.lit("")))


def paragraphs(text: Column) -> Column:
    """array of (start, end, text): stretches between blank lines, with code point offsets, end exclusive."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)(\n[ \t]*(?=\n)|\S.*?(?=\n[ \t]*\n|$(?!\n))|\s)"), 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def add(s: Column, p: Column) -> Column:
        end = s["at"] + F.length(p)
        now = F.struct(s["at"].alias("start"), end.alias("end"), p.alias("text"))
        return F.struct(end.alias("at"), F.when(p.rlike(r"^\S"), F.concat(s["out"], F.array(now))).otherwise(s["out"]).alias("out"))

    return F.aggregate(pieces, start, add, lambda s: s["out"])


def sections(answers: DataFrame) -> DataFrame:
    """answer_id, paragraph, start, end, text, cited of ``answers`` (answer_id, text, annotations: array of start_index, end_index, url).

    An annotation belongs to the paragraphs that it overlaps; one without an end to those that begin no later than it.
    """
    p = answers.select("answer_id", "annotations", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "p"))

    def belongs(a: Column) -> Column:
        tail = F.when(a["end_index"].isNotNull(), a["end_index"] > F.col("p.start")).otherwise(a["start_index"] >= F.col("p.start"))
        return F.coalesce((a["start_index"] < F.col("p.end")) & tail, F.lit(False))

    cited = F.transform(F.filter(F.coalesce("annotations", F.array().cast("array<struct<start_index:int,end_index:int,url:string>>")), belongs), lambda a: a["url"])
    return p.select("answer_id", "paragraph", "p.start", "p.end", clean_output(F.col("p.text")).alias("text"), cited.alias("cited")).where("text <> ''")


def section_sources(found: DataFrame, domains: tuple[str, ...] = OFFICIAL_DOMAINS) -> DataFrame:
    """answer_id, paragraph, url, title, source_rank: the official sources of each of ``sections``' paragraphs, once each."""
    cited = found.select("answer_id", "paragraph", F.posexplode("cited").alias("at", "url")).withColumn("title", F.lit(None).cast("string"))
    ranked = unique_sources(cited, ["answer_id", "paragraph"], "at", domains)
    return ranked.select("answer_id", "paragraph", "url", source_title(F.col("url"), F.col("title")).alias("title"), "source_rank")
