"""Operators that SQL doesn't express, against plain Python, and their edge cases."""

import random
import re

from pyspark.sql import functions as F

from quernstone.config import ChunkParams, LimiterParams
from quernstone.functions import text as T
from quernstone.functions import urls as U
from quernstone.operators import answer, checklist, corpus, intent, search
from quernstone.sources import corpus_io
from quernstone.streaming import limits

PARAGRAPH = "Forms are sent by mail to the office that the instructions name, together with the fee and two photographs of the applicant. "


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


def test_parts_cover_the_text_and_stay_short():
    r = random.Random(1)
    for n in (0, 1, 1999, 2000, 2001, 9000):
        text = "".join(r.choice("ab. \n") for _ in range(n))
        parts = corpus.split_parts(text, ChunkParams())
        assert all(len(p) <= 2001 for p in parts)
        at = 0
        for p in parts:
            found = text.find(p, max(0, at - 2300))
            assert found >= 0 and found <= at + 60
            at = found + len(p)
        assert not text[at:].strip()


def test_packing_joins_short_paragraphs(spark):
    paragraphs = ["a" * 900, "b" * 890, "c" * 1000, "d" * 5000, "e"]
    got = one(spark, corpus.pack_paragraphs(F.col("t")), t="\n\n".join(paragraphs))
    want, now = [], ""
    for p in paragraphs:
        if not now:
            now = p
        elif len(now) + 2 + len(p) <= 1800:
            now += "\n\n" + p
        else:
            want.append(now)
            now = now[-220:] + "\n\n" + p
    assert got == [*want, now]
    assert one(spark, corpus.pack_paragraphs(F.col("t")), t=None) == []


def test_page_reading(spark):
    html = f"""<html><head><title>Short</title><meta property="og:title" content="Graph"><meta name="description" content="About it"></head>
    <body><nav>Menu</nav><main><h1>Head&nbsp;line</h1><div class="breadcrumb x">Crumb</div><p>{PARAGRAPH}<p>{PARAGRAPH}<ul><li>one<li>two</ul>
    <script>var x = "</p>";</script><span aria-hidden="true">hidden</span></main><footer>Foot</footer></body></html>"""
    rows = spark.createDataFrame([("u", html), ("short", "<h1>t</h1><p>too short"), ("null", None)], "url string, html string")
    (row,) = corpus.extract_pages(rows).collect()
    assert (row.url, row.title, row.description) == ("u", "Head line", "About it")
    assert row.text.count(PARAGRAPH.strip()) == 2 and "one\n\ntwo" in row.text
    assert not re.search("Menu|Crumb|var x|hidden|Foot", row.text)
    assert len(row.chunks) == 1


def test_passages_keep_their_numbers_and_error_pages_go(spark):
    pages = spark.createDataFrame([(1, "u", "T", None, [" ", "real text"], ""), (2, "v", "Page Not Found", None, ["x"], ""), (3, "w", "U", None, [], "whole text")], "page_ord long, url string, title string, description string, chunks array<string>, text string")
    passages = corpus.to_passages(pages)
    assert sorted((r.page_ord, r.chunk_index) for r in passages.collect()) == [(1, 1), (2, 0), (3, 0)]
    index = search.build_index(passages, pages.agg(F.count("*").alias("page_count")))
    assert index.stats.first().n == 2 and index.stats.first().page_count == 3
    asked = spark.createDataFrame([(1, "whole text"), (2, ""), (3, None)], "query_id long, text string")
    hits = search.search(index, asked, 5).collect()
    assert [(r.query_id, r.rank, r.url) for r in hits if r.query_id == 1][0] == (1, 1, "w") and {r.query_id for r in hits} == {1}


def test_urls(spark):
    base = "https://www.uscis.gov"
    cases = {"https://www.uscis.gov//green-card/?a=1#x": f"{base}/green-card", "/forms/": f"{base}/forms", "https://other.org/forms": None, "mailto:x@y.z": None, base: f"{base}/"}
    rows = spark.createDataFrame([(k,) for k in cases], "u string").select("u", U.normalize_url(F.col("u"), base).alias("n"), U.is_relevant(F.col("u"), disallowed=("/forms/x",)).alias("r")).collect()
    assert {r.u: r.n for r in rows} == cases
    assert {r.u: r.r for r in rows} == {"https://www.uscis.gov//green-card/?a=1#x": True, "/forms/": True, "https://other.org/forms": False, "mailto:x@y.z": False, base: False}
    assert corpus_io.robots_disallows("User-agent: *\nDisallow: /a # no\nUser-agent: b\nDisallow: /c\nuser-agent: *\nDisallow: /a\nDisallow: d") == ["/a"]


def test_upkeep(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("gone", "1"), ("n", "1")], "url string, last_modified string")
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("n", None)], "url string, last_modified string")
    assert {r.url for r in corpus.pending(found, old).collect()} == {"b", "c"}
    assert corpus.pending(found, old, refresh=True).count() == 4
    merged = corpus.merge(old, spark.createDataFrame([("b", "2")], old.schema), found)
    assert sorted(map(tuple, merged.collect())) == [("a", "1"), ("b", "2"), ("n", "1")]


def test_corpus_files(spark, tmp_path):
    path = str(tmp_path / "c")
    assert corpus_io.read_corpus(spark, path).count() == 0
    df = spark.createDataFrame([("b", "t", None, None, None, "x", ["x"]), ("a", "t", None, None, None, "y", ["y"])], corpus_io.RECORD)
    corpus_io.write_corpus(df, path, compress=True)
    (tmp_path / "c" / "bad.json").write_text("{broken\n")
    assert sorted(r.url for r in corpus_io.read_corpus(spark, path).collect()) == ["a", "b"]
    (tmp_path / "s.xml").write_text("<urlset><url><loc> https://x/1 </loc><lastmod>2024-01-02</lastmod></url><url><loc>https://x/2</loc></url><url><loc>https://x/1</loc><lastmod>2024-01-03</lastmod></url></urlset>")
    entries = corpus_io.read_sitemap(spark, str(tmp_path / "s.xml"))
    assert sorted((tuple(r) for r in corpus.last_wins(entries, "url", "place").select("url", "last_modified").collect()), key=str) == [("https://x/1", "2024-01-03"), ("https://x/2", None)]
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc> https://x/s1.xml </loc></sitemap><sitemap><loc>https://x/s2.xml</loc></sitemap></sitemapindex>")
    assert sorted(r.url for r in corpus_io.sitemap_index(spark, str(tmp_path / "i.xml")).collect()) == ["https://x/s1.xml", "https://x/s2.xml"]


def test_guards(spark):
    bad = ["my number is A123456789", "éA1234567", "receipt ABC1234567890.", "123-45-6789", "4539 1488 0343 6467", "passport number X1234567"]
    fine = ["how do I find my receipt number", "room A12345", "call 12345", ""]
    rows = spark.createDataFrame([(t,) for t in [*bad, *fine]], "question string").select("question", F.lit(None).cast("string").alias("conversation"), F.lit("").alias("checklist_context"), F.lit("pt-BR").alias("language"))
    got = {r.question: r.error for r in answer.validate(rows).collect()}
    assert all(got[t] == "sensitive_identifier" for t in bad)
    assert [got[t] for t in fine] == [None, None, None, "question_required"]


def test_sections_and_output(spark):
    text = "First **bold** line.\nStill first.\n \nSecond [link](https://x.gov/a) here.\n\n\nThird."
    second = text.index("Second")
    marks = [(0, 5, "a"), (second + 1, second + 4, "b"), (5, None, "c"), (None, 3, "d")]
    df = spark.createDataFrame([(1, text, marks), (2, None, None)], "answer_id long, text string, annotations array<struct<start_index:int,end_index:int,url:string>>")
    got = answer.sections(df).orderBy("answer_id", "paragraph").collect()
    # a mark without an end goes with the paragraphs that begin no later
    assert [(r.text, r.cited) for r in got] == [("First bold line.\nStill first.", ["a", "c"]), ("Second link here.", ["b"]), ("Third.", [])]
    assert all(text[r.start : r.end].strip() for r in got)
    # cite marks go, the blanks on both sides of one stay
    assert one(spark, answer.clean_output(F.col("t")), t="# Title\nSee \ue200citex\ue201 it .") == "Title\nSee  it."


def test_sentences(spark):
    text = PARAGRAPH + "Unrelated words stand in this sentence so that it is long enough to count. The fee is paid by check or money order to the office named in the form."
    df = spark.createDataFrame([(text, "which fee office form"), ("tiny", "x"), (None, "x")], "excerpt string, question string")
    got = [r.passage for r in answer.useful_sentences(df).collect()]
    assert got[0].startswith("Forms are") and got[0].endswith("in the form.") and got[1:] == ["tiny", ""]


def test_intents_and_steps(spark):
    assert one(spark, intent.exact_score(T.normalize_intent(F.col("q")), T.normalize_intent(F.col("t"))), q="Ouvrez la page", t="ouvrez") == 5
    assert one(spark, intent.exact_score(T.normalize_intent(F.col("q")), T.normalize_intent(F.col("t"))), q="couvrez", t="ouvrez") == 0
    assert one(spark, intent.exact_score(T.normalize_intent(F.col("q")), T.normalize_intent(F.col("t"))), q="请打开页面", t="打开") == 5
    steps = spark.createDataFrame([("f", 0, "send", ["send form"]), ("f", 1, "photo", ["take photo"])], "flow_id string, step_ord int, step_id string, parts array<string>")
    asked = spark.createDataFrame([(1, "f", "I took the photo"), (2, "f", "send form now"), (3, "f", "zzz")], "query_id long, flow_id string, text string")
    assert {r.query_id: r.step_id for r in intent.find_step(asked, steps).collect()} == {1: "photo", 2: "send"}


def test_checklists(spark):
    assert [(r.id, r.iso) for r in one(spark, checklist.key_dates(checklist.valid_date(F.col("d"))), d="2024-03-15")] == [("reminder_30", "2024-02-14"), ("reminder_7", "2024-03-08"), ("target_date", "2024-03-15")]
    assert one(spark, checklist.key_dates(checklist.valid_date(F.col("d"))), d="2024-02-30") == []
    items = spark.createDataFrame([("i", {"title_en": "x", "title_es": " ", "title_fr": "y"})], "item_id string, fields map<string,string>")
    assert [tuple(r) for r in checklist.incomplete_fields(items, ("es", "fr")).collect()] == [("i", "es", "title")]
    assert checklist.flat_keys({"a": {"b": "x"}, "c": [1]}) == [("a.b", "x"), ("c", "[1]")]
