import random

import pytest

from quernstone.llm.html_main import ExtractParams, decode, extract, features, model, parse, texts_of, training_labels, training_page, weights

from .pages import PAGES

PAGE = """<!DOCTYPE html><html><head><title>no</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=/>menu</a><li><a href=/b>more</a></ul></nav>
<div class="ad">buy now, cheap.</div><article><h1>A&amp;B  title</h1><p>First &eacute; para.<p><b>Second
 line, with text.<br><p>Third one, here.</article><div id="comments"><p>I liked it, thanks.</p></div><footer>&copy; all</footer>"""


def test_the_article_is_kept_and_the_rest_not():
    assert texts_of([PAGE], model(ExtractParams())) == ["A&B title\nFirst é para.\nSecond line, with text.\nThird one, here."]


@pytest.mark.parametrize("name", PAGES)
def test_pages_written_by_hand(name):
    html, text = PAGES[name]
    assert texts_of([html], model(ExtractParams())) == [text]


def test_unseen_layouts():
    boosted, r, exact = model(ExtractParams()), random.Random(4242), 0
    for _ in range(150):
        page = parse(training_page(r))
        x = features(page)
        chosen, truth = decode(page, boosted.margin(x), weights(x)), training_labels(page)
        text = lambda keep: [b for o, b, _ in page.runs if keep[o]]  # noqa: E731, B023
        exact += text(chosen) == text(truth)
        for i in range(1, len(page.tag)):  # never in again below a node that has left
            path, p = [], i
            while p >= 0:
                path.append(bool(chosen[p]))
                p = page.parent[p]
            assert "".join("01"[c] for c in path[::-1]).strip("0").count("0") == 0
    assert exact >= 0.93 * 150


def test_rows_and_edges(spark):
    rows = [(1, "u", PAGE, 0), (1, "u", PAGE, 0), (2, None, None, 0), (3, "v", "", 0), (4, "w", "<p", 0), (None, "x", "<article><p>" + "long text. " * 30_000, 0), (6, "y", "<!-- <p> never closed", 0), (7, "z", "</div></p><li><td>a 'quote\">", 0)]
    got = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert [r.page_id for r in got] == [r[0] for r in rows] and [r.url for r in got] == [r[1] for r in rows]
    assert all(r.n_chars == len(r.text) for r in got) and got[2].text == got[3].text == ""
    assert got[0].text == got[1].text != "" and got[5].n_chars == len("long text. " * 30_000) - 1
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
