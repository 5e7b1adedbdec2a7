"""Small cases of commands, states, corpus files and answers' metadata, nulls and empty tables among them."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from quernstone.config import QuotaParams
from quernstone.functions import text as T
from quernstone.functions import urls
from quernstone.operators import answer, checklist, corpus, search, tasks
from quernstone.plans.dims import LABELS
from quernstone.sources import corpus_io
from quernstone.streaming import limits

SCORES = "open summary checklist summary_phrase question date_noun date_verb undo mark all clear reminder create link resource privacy capability".split()


def actions(spark, rows):
    """rows: text, scores, flow, step, plus."""
    data = [(i, t, f, s, p, *[sc.get(k) for k in SCORES]) for i, (t, sc, f, s, p) in enumerate(rows)]
    df = spark.createDataFrame(data, "i long, text string, flow string, step string, plus boolean, " + ", ".join(f"{k} int" for k in SCORES))
    got = df.select("i", tasks.task_action(F.col("text"), T.normalize_intent(F.col("text")), {k: F.col(k) for k in SCORES}, F.col("flow"), F.col("step"), F.col("plus")).alias("a")).collect()
    return [r.a for r in sorted(got, key=lambda r: r.i)]


def test_commands_in_their_order(spark):
    rows = [
        ("open it", {"open": 5}, "f", None, False), ("open it", {"open": 5, "question": 5, "capability": 5}, "f", None, True), ("open", {"open": 5, "link": 5, "privacy": 5}, None, None, None),
        ("open", {"open": 5, "reminder": 5}, None, None, None), ("sum", {"summary": 5}, "f", None, True), ("sum", {"summary": 5}, None, None, True), ("list", {"checklist": 5}, None, None, True),
        ("list", {"checklist": 5}, None, None, None), ("remind me 30 days before", {"reminder": 5, "create": 5}, "f", None, True), ("remind 7", {"reminder": 5, "create": 5}, "f", None, True),
        ("remind", {"reminder": 5, "create": 5}, "f", None, True), ("when is it", {"date_noun": 5, "question": 5}, "f", None, True), ("set 2024-02-30", {"date_verb": 5}, "f", None, True),
        ("set 2024-02-28", {"date_noun": 5, "question": 5}, "f", None, True), ("set the date", {"date_noun": 5, "date_verb": 5}, "f", None, True), ("all done", {"mark": 5, "all": 5}, "f", None, True),
        ("done", {"mark": 5}, "f", None, True), ("done", {"mark": 5}, "f", "s", True), ("not all", {"undo": 5, "all": 5, "mark": 5}, "f", "s", True), ("clear", {"clear": 5, "checklist": 3}, "f", None, True), ("help", {"capability": 5}, None, None, None), (None, {}, None, None, None),
    ]
    want = ["open_flow", "capabilities", "open_link", "open_reminders", "summary", None, "progress", "requires_plus", "reminder_30", "reminder_7", "reminder_0", "date_query", "need_date", "save_date", "need_date", "mark_all", "need_step", "mark_step", "undo_step", None, "capabilities", None]
    assert actions(spark, rows) == want and actions(spark, []) == []


def test_dates_and_reminders(spark):
    due = F.lit("2024-03-31").cast("date")
    row = spark.range(1).select(
        tasks.reminder_time(due, F.lit(30)).alias("at"), tasks.reminder_status(due, F.lit(14), F.current_timestamp()).alias("other"), tasks.reminder_status(F.lit(None).cast("date"), F.lit(7), F.current_timestamp()).alias("none"),
        tasks.clamped_day(F.lit(2023), F.lit(2), F.lit(31)).alias("day"), F.size(tasks.year_choices(F.lit(2020))).alias("years"), tasks.quick_reminders(F.lit("2024-01-01").cast("timestamp")).alias("quick"), tasks.date_in(F.lit("on 2024-01-02.")).alias("said"), tasks.date_in(F.lit("x12024-01-02")).alias("unsaid"),
    ).first()
    assert row.at == datetime.datetime(2024, 3, 1, 9) and (row.other, row.none, row.day, row.years) == ("no_such_reminder", "no_date", 28, 21)
    assert [(q.seconds, q["at"].day) for q in row.quick] == [(1_209_600, 15), (604_800, 8), (2_592_000, 31)] and (row.said, row.unsaid) == ("2024-01-02", None)


def test_progress_of_keys_without_steps(spark):
    steps = spark.createDataFrame([("f", 0, "a"), ("f", 1, "b"), ("g", 0, "c")], "flow_id string, step_ord int, step string")
    done = spark.createDataFrame([(1, "f", "b"), (1, "f", "b"), (1, "f", "zzz"), (None, "f", "a")], "user long, flow_id string, step string")
    users = spark.createDataFrame([(1,), (2,)], "user long")
    got = {(r.user, r.flow_id): (r.total, r.completed, r.remaining, r.percent) for r in checklist.progress_lists(steps, done, users, ["user"]).collect()}
    assert got == {(1, "f"): (2, ["b"], ["a"], 50), (1, "g"): (1, [], ["c"], 0), (2, "f"): (2, [], ["a", "b"], 0), (2, "g"): (1, [], ["c"], 0)}
    text = checklist.flow_summary(F.lit("F"), F.lit(None).cast("string"), checklist.key_dates(F.lit(None).cast("date")), LABELS)
    one = checklist.progress_lists(steps, done, users, ["user"]).where("user = 1 and flow_id = 'f'").select(text.alias("t")).first().t
    assert one == "F: 1/2 complete (50%).\nDue: not set.\nCompleted: b.\nRemaining: a.\nKey dates: not calculated."
    assert checklist.progress_lists(steps, done.limit(0), users.limit(0), ["user"]).count() == 0 and checklist.progress(steps.select("step"), done.limit(0), ["user"]).count() == 0


def test_states_round_trip(spark):
    rows = spark.createDataFrame([("a", '{"noticeDate":"2024-01-01","dueDate":"2024-02-01","done":{"x":true}}'), ("b", "{broken"), ("c", None), ("d", "[]")], "flow_key string, json string")
    states = checklist.read_states(rows)
    got = {r.flow_key: (r.notice_date, r.due_date, r.done) for r in states.collect()}
    assert got == {"a": ("2024-01-01", "2024-02-01", {"x": True}), **{k: ("", "", {}) for k in "bcd"}}
    assert {r.flow_key: r.done for r in checklist.read_states(checklist.stored_states(states)).collect()} == {k: v[2] for k, v in got.items()}


def test_localized_fields(spark):
    df = spark.createDataFrame([({"title": "t", "title_en": "e", "title_es": "", "other_en": "o"},)], "m map<string,string>")
    r = df.select(checklist.pick_localized(F.col("m"), "title", "es").alias("p"), F.array_sort(checklist.localized_values(F.col("m"), "title")).alias("v")).first()
    assert r.p == "e" and r.v == ["", "e", "t"]


def test_corpus_upkeep_in_one_run(spark, tmp_path):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("d", "1")], "url string, last_modified string")
    cached = spark.createDataFrame([("a", "1", "old"), ("b", "1", "old"), ("gone", "1", "old")], "url string, last_modified string, html string")
    fetched = spark.createDataFrame([("a", 200, "text/html", "n"), ("b", 200, "Text/HTML; x", "n"), ("c", 500, "text/html", "n"), ("d", 200, "application/pdf", "n")], "url string, status int, content_type string, html string")
    after = corpus.crawl(found, cached, fetched)
    assert sorted(map(tuple, after.collect())) == [("a", "1", "old"), ("b", "2", "n")]
    assert {r.url for r in corpus.pending(found, after).collect()} == {"c", "d"}  # resumed: only what failed is fetched again
    assert tuple(corpus.crawl_counts(corpus.fetch_errors(fetched)).first()) == (2, 2, 4)
    assert [r.error for r in corpus.fetch_errors(spark.createDataFrame([(None, None)], "status int, content_type string")).collect()] == ["status 0"]


def test_packages_manifests_and_keyed_reads(spark, tmp_path):
    path, packed = str(tmp_path / "c"), str(tmp_path / "p")
    rows = [(u, "t", None, None, None, "x" * 500, None) for u in ("/b", "/a/b", "/a-b", "/B", "/a")]
    corpus_io.write_corpus(spark.createDataFrame(rows, corpus_io.RECORD).coalesce(1), path)
    texts = [json.loads(line)["url"] for f in sorted((tmp_path / "c").glob("part-*")) for line in f.read_text().splitlines()]
    assert texts == ["/a", "/a-b", "/a/b", "/b", "/B"]  # as people sort
    sizes = corpus_io.package(spark, path, packed)
    assert sizes["source_bytes"] > sizes["packaged_bytes"] > 0 and corpus_io.read_corpus(spark, str(tmp_path / "none"), packed).count() == 5
    with pytest.raises(FileNotFoundError):
        corpus_io.package(spark, str(tmp_path / "none"), packed)
    (tmp_path / "k.json").write_text('{"url":"a","title":"1"}\n{"url":"b","title":"2"}\n{broken\n{"url":"a","title":"3"}\n')
    assert {r.url: r.title for r in corpus_io.read_keyed(spark, str(tmp_path / "k.json")).collect()} == {"a": "3", "b": "2"}
    pages = spark.range(3)
    counts = corpus_io.health(pages, pages, 30, configured=True)
    assert tuple(counts.first()) == (3, 3, 30, True)
    corpus_io.write_manifest(spark, str(tmp_path / "m.json"), counts, version=1)
    assert json.loads((tmp_path / "m.json").read_text()) == {"pages": 3, "passages": 3, "languages": 30, "configured": True, "version": 1}


def test_answers_metadata(spark):
    answers = spark.createDataFrame([("x", None, "es", None, True), ("y", "web", None, True, None)], "answer_id string, grounded_on string, language string, cached boolean, degraded boolean")
    cited = spark.createDataFrame([("x", "https://travel.state.gov/a/?q", "A", 1), ("x", "https://travel.state.gov/a", "B", 2), ("x", "https://evil.org/", "C", 3)], "answer_id string, url string, title string, at int")
    got = {r.answer_id: r for r in answer.with_metadata(answers, answer.unique_sources(cited, ["answer_id"], "at"), cited, F.lit("a,b")).collect()}
    assert [(s.title, s.url) for s in got["x"].sources] == [("A", "https://travel.state.gov/a")] and got["y"].sources == [] and got["x"].followups == ["a", "b"]
    assert tuple(got["x"].answer_profile) == ("es", 1, 3, "unknown", False, True) and tuple(got["y"].answer_profile) == ("en", 0, 0, "web", True, False)
    row = spark.range(1).select(answer.known_followups(F.array(*map(F.lit, ("b", "zz", "a", "b", "c", "d"))), ("a", "b", "c", "d")).alias("f"), answer.resolve_language(F.lit("ES-mx"), ("en", "es")).alias("l"), answer.resolve_language(F.lit("xx-YY"), ("en", "es")).alias("m"), answer.cache_key(F.lit(" ?! "), F.lit("en"), F.lit("m"), F.lit("v")).alias("k"), urls.client_address(F.lit(" 1.2.3.4 , 5"), F.lit("r")).alias("c"), urls.client_address(F.lit(None).cast("string"), F.lit(None).cast("string")).alias("d")).first()
    assert tuple(row) == (["b", "a", "c"], "es", "en", "", "1.2.3.4", "unknown")


def test_prior_questions_keep_little_state(spark):
    turns = [(1, i, "user", t) for i, t in enumerate(("A b", "a  B!", "a b"))] + [(2, 0, "user", "x"), (2, 1, "user", ""), (2, 2, "user", "y")] + [(3, 0, "user", "only")] + [(4, 0, "user", None), (4, 1, "user", "z")]
    got = {r.conv_id: r.has_prior_different for r in answer.last_user_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: False, 2: True, 3: False, 4: False}


def test_latin_folding_equals_the_decomposed_form(spark):
    import unicodedata

    texts = ["ÀÉîõü ÇŁø ß Œ œ", "\ufb01ne \u00bd \u2026 \u201cq\u201d \u2013", "Привет ёж", "दिल्ली", "北京 ﾊﾝ", "I\u0307stanbul e\u0301", "Ǆ ǆ ȟ ḃ ệ", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.normalize(F.col("t")).alias("n"), T.normalize_intent(F.col("t")).alias("m")).collect()
    import regex

    for r in rows:
        low = (texts[r.i] or "").lower()
        n = regex.sub(r"\p{M}", "", unicodedata.normalize("NFKD", low))
        assert r.n == " ".join(regex.sub(r"[^\p{L}\p{N}\s-]", " ", n).split())
        m = regex.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFD", low))
        assert r.m == regex.sub(r"[^\p{L}\p{N}]+", " ", m).strip()


def test_search_of_nothing(spark):
    passages = spark.createDataFrame([(1, 0, "u", None, None, None), (2, 0, "u", None, None, " ")], "page_ord long, chunk_index int, url string, title string, description string, text string")
    asked = spark.createDataFrame([(1, "some words"), (2, None), (3, "the")], "query_id long, text string")
    assert search.search(search.build_index(passages), asked).count() == 0 and search.search(search.build_index(passages), asked.limit(0)).count() == 0
    events = spark.createDataFrame([], "user_id long, ts timestamp, event_id long")
    flags = spark.createDataFrame([(1, i, f"2024-01-{i + 1:02d}", i != 1, u) for u, i in ((False, 0), (False, 1), (False, 2), (False, 3), (False, 4))] + [(2, 9, "2024-01-01", True, True), (3, 10, "2024-01-31", None, None)], "user_id int, event_id int, ts string, answered boolean, plus boolean")
    quota = {r.event_id: (r.used, r.allowed) for r in limits.answered_quota(flags, "user_id", "ts", "event_id", "answered", "plus", QuotaParams(2)).collect()}
    assert quota == {0: (0, True), 1: (1, True), 2: (1, True), 3: (2, False), 4: (2, False), 9: (0, True), 10: (0, True)}
    assert limits.monthly_quota(events, "user_id", "ts", "event_id").count() == 0 and limits.cache_hits(events, "user_id", "ts", "event_id").count() == 0


def test_sections_to_show(spark):
    kind = "text string, sources array<string>, sections array<struct<text: string, sources: array<string>>>"
    rows = [("a\n \n b \n\n", ["s"], []), ("a", ["s"], [("x", ["t"]), (" ", []), (None, [])]), ("a", [], None), (" ", ["s"], []), (None, ["s"], [(" ", [])])]
    d = spark.createDataFrame(rows, kind).select(answer.revealed_sections(F.col("text"), F.col("sources"), F.col("sections")).alias("r"))
    assert [[tuple(x) for x in r.r] for r in d.collect()] == [[("a", ["s"]), ("b", ["s"])], [("x", ["t"])], [("a", [])], [], []]
