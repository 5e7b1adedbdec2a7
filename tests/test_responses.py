"""From raw responses to answers, on small cases; annotations against the array form."""

import json

from pyspark.sql import functions as F

from quernstone.operators import answer, responses

PAGE = "https://www.uscis.gov/green-card/x"


def body(*contents, **more):
    return json.dumps({"output": [{"type": "web_search_call", "status": "completed", **({"action": more.pop("action")} if "action" in more else {})}, {"type": "message", "content": list(contents)}], **more})


def said(text, *marks):
    return {"type": "output_text", "text": text, "annotations": list(marks)}


def test_output_text_joins_parts_and_prefers_its_own(spark):
    rows = [(1, body(said(" One. "), {"type": "refusal", "text": "no"}, said(""), said("**Two** ."))), (2, body(said("x"), output_text=" own ")), (3, "{"), (4, None), (5, "{}"), (6, '{"output": [{"content": null}, null]}')]
    d = responses.parsed(spark.createDataFrame(rows, "id int, body string"))
    assert {r.id: r.t for r in d.select("id", responses.output_text(F.col("data")).alias("t")).collect()} == {1: "One.\n\nTwo.", 2: "own", 3: "", 4: "", 5: "", 6: ""}


def test_the_first_attempt_that_is_neither_refused_nor_broken(spark):
    rows = [(1, 1, 503, "a"), (1, 2, 200, "b"), (1, 3, 200, "c"), (2, 1, 400, "a"), (2, 2, 200, "b"), (3, 1, 429, "a"), (3, 2, 500, "b"), (4, 1, 200, "a"), (4, 1, 200, "a")]
    got = responses.chosen_attempts(spark.createDataFrame(rows, "request_id int, attempt int, status int, body string")).collect()
    assert {r.request_id: (r.attempt, r.status) for r in got} == {1: (2, 200), 2: (1, 400), 3: (2, 500), 4: (1, 200)}


def test_annotations_as_rows_equal_the_array_form(spark):
    text = "\n\n".join(f"paragraph {i} " + "word " * (i % 7) for i in range(60)) + "\n \n\nlast"
    marks = [(s, None if s % 4 == 0 else s + s % 9 * 40 - 40, f"u{s}") for s in range(0, len(text) + 50, 13)] + [(None, 5, "none")]
    one = spark.createDataFrame([(7, text, marks)], "answer_id int, text string, annotations array<struct<start_index: int, end_index: int, url: string>>")
    want = sorted((r.paragraph, u) for r in answer.sections(one).collect() for u in r.cited)
    rows = one.select("answer_id", F.explode("annotations").alias("a")).select("answer_id", "a.*")
    for width in (7, 100, 10**6):
        got = responses.aligned(responses.paragraph_rows(one.select("answer_id", "text"), ["answer_id"]), rows, ["answer_id"], width)
        assert sorted((r.paragraph, r.url) for r in got.collect()) == want and len(want) > 60


def test_a_long_answer_with_many_annotations(spark):
    text = "\n\n".join(["some text here"] * 3000)
    d = spark.createDataFrame([(1, text)], "answer_id int, text string")
    marks = spark.range(100_000).select(F.lit(1).alias("answer_id"), (F.col("id") * 16 % len(text)).alias("start_index"), (F.col("id") * 16 % len(text) + 3).alias("end_index"))
    assert responses.aligned(responses.paragraph_rows(d, ["answer_id"]), marks, ["answer_id"]).count() == 100_000


def test_from_requests_to_answers(spark):
    ask = lambda i, q: (i, q, "", "", "en")
    requests = spark.createDataFrame([ask(1, "How do I file?"), ask(2, "How do I file?"), ask(3, "my ssn is 123-45-6789"), ask(4, ""), ask(5, "Where?"), ask(6, "Which?")], "request_id long, question string, conversation string, checklist_context string, language string")
    sentence = "You file the form online or by mail with all of the documents that it lists."
    hits = spark.createDataFrame([(1, 1, 9.0, "Form", PAGE, sentence), (2, 1, 9.0, "Form", PAGE, sentence), (2, 2, 8.0, "Other", PAGE + "2", "x"), (2, 3, 1.0, "Far", PAGE + "3", "x"), (6, 1, 5.0, "Six", PAGE + "6", "x")], "query_id long, rank int, score double, title string, url string, excerpt string")
    first = "Adjust here. ([uscis.gov](https://www.uscis.gov/a))"
    mark = {"type": "url_citation", "start_index": first.index("([") if "([" in first else 0, "end_index": len(first), "title": "Adjust", "url": "https://www.uscis.gov/a?utm_source=x"}
    elsewhere = {"url_citation": {"start_index": len(first) + 4, "url": "https://travel.state.gov/b", "title": ""}}
    cited = body(said(first + "\n\nConsulates too, and far away.", mark, elsewhere))
    searched = body(said("Plain."), action={"sources": [{"url": "https://www.cbp.gov/c"}, {"url": "https://example.com/no"}, {"url": None}]})
    attempts = spark.createDataFrame([(2, 1, 200, body(said("Plain text."))), (5, 1, 500, "x"), (5, 2, 200, cited), (6, 1, 200, searched), (3, 1, 200, cited)], "request_id long, attempt int, status int, body string")
    got = {r.request_id: r for r in responses.answer_requests(requests, hits, attempts).collect()}
    assert (got[3].status, got[3].error, got[3].output_text, got[3].degraded) == (400, "sensitive_identifier", None, None) and got[4].error == "question_required"
    assert got[1].degraded and got[1].grounded_on == "local_corpus" and sentence in got[1].output_text and [s.url for s in got[1].sources] == [PAGE] and len(got[1].sections) == 1
    assert not got[2].degraded and got[2].output_text == "Plain text." and [s.url for s in got[2].sources] == [PAGE, PAGE + "2"] and got[2].grounded_on == "local_corpus"
    assert got[5].output_text == "Adjust here.\n\nConsulates too, and far away." and [(s.title, s.url) for s in got[5].sources] == [("Adjust", "https://www.uscis.gov/a"), ("U.S. Department of State", "https://travel.state.gov/b")]
    assert [[s.url for s in x.sources] for x in got[5].sections] == [["https://www.uscis.gov/a"], ["https://travel.state.gov/b"]]
    assert got[6].grounded_on == "live_official_sources" and [(s.title, s.url) for s in got[6].sources] == [("U.S. Customs and Border Protection", "https://www.cbp.gov/c")]
    assert responses.answer_requests(requests.limit(0), hits, attempts).count() == 0
