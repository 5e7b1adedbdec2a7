"""Whole discovery of a site, the manifest, and a crawl that is killed and started again."""

import json

import pytest
from pyspark.sql import functions as F

from quernstone.config import UrlRules
from quernstone.sources.sitemaps import discover_site, elements, site_entries, text_of, write_manifest
from quernstone.streaming import crawl

ORIGIN = "https://www.uscis.gov"


def sitemap(*entries):
    return "<?xml version='1.0'?><urlset xmlns='http://www.sitemaps.org/schemas/sitemap/0.9'>" + "".join(f"<url><loc>{u}</loc>{'' if d is None else f'<lastmod> {d} </lastmod>'}</url>" for u, d in entries) + "</urlset>"


@pytest.fixture
def site(tmp_path):
    files = {
        "sitemap.xml": "<sitemapindex>" + "".join(f"<sitemap><loc>{ORIGIN}/s-{i}.xml</loc></sitemap>" for i in (2, 1, 3)) + "</sitemapindex>",
        "s-1.xml": sitemap((f"{ORIGIN}/forms/b", "new"), (f"{ORIGIN}/family/a?x=1", None), (f"{ORIGIN}/tools/private/p", "x")),
        "s-2.xml": sitemap((f"{ORIGIN}/forms/b", "old"), (f"{ORIGIN}/archive/z", "x"), ("", "x"), ("https://example.com/forms/q", "x")),
        "s-3.xml": "<urlset><!-- <url><loc>no</loc></url> --><url><loc><![CDATA[%s/green-card/c]]></loc><lastmod></lastmod></url><url><lastmod>1</lastmod></url></urlset>" % ORIGIN,
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_index_children_and_rules_give_ordered_pages(spark, site):
    got = discover_site(spark, "User-agent: *\nDisallow: /tools/private\n", path=f"{site}/sitemap.xml", base=site).collect()
    assert [tuple(r) for r in got] == [(f"{ORIGIN}/family/a", None), (f"{ORIGIN}/forms/b", "new"), (f"{ORIGIN}/green-card/c", None)]
    e = site_entries(spark, path=f"{site}/sitemap.xml", base=site)
    assert e.rdd.getNumPartitions() == 3 and [r.place.file for r in e.collect() if r.url.endswith("forms/b")] == [0, 1]
    # by name, the second child comes last
    by_name = discover_site(spark, "", UrlRules(), folder=site, pattern="s-*.xml")
    assert {r.url: r.last_modified for r in by_name.collect()}[f"{ORIGIN}/forms/b"] == "old"


def test_no_and_missing_children(spark, tmp_path):
    (tmp_path / "empty.xml").write_text("<sitemapindex/>")
    assert site_entries(spark, path=f"{tmp_path}/empty.xml").count() == 0
    (tmp_path / "broken.xml").write_text("<sitemapindex><sitemap><loc>gone.xml</loc></sitemap></sitemapindex>")
    with pytest.raises(Exception, match="gone.xml"):
        site_entries(spark, path=f"{tmp_path}/broken.xml", base=str(tmp_path)).collect()


def test_text_of_elements():
    assert [text_of(x) for x in elements("<A x='1'> b &amp; <i>c</i> </a><a><![CDATA[<&amp;>]]></a>", "a")] == ["b & c", "<&amp;>"]


@pytest.mark.parametrize("n", [0, 1, 40])
def test_manifest_is_one_ordered_document(spark, tmp_path, n):
    rows = [(f"{ORIGIN}/p{(i * 7) % 40:02d}", None if i % 2 else 'a "quoted" date') for i in range(n)]
    write_manifest(spark.createDataFrame(rows, "url string, last_modified string").repartition(4), f"{tmp_path}/manifest.json", source="s")
    got = json.loads((tmp_path / "manifest.json").read_text())
    assert got["source"] == "s" and got["pageCount"] == n and [(p["url"], p["lastModified"]) for p in got["pages"]] == sorted(rows)


def test_a_killed_crawl_goes_on_and_fetches_nothing_twice(spark, tmp_path):
    found = spark.createDataFrame([(f"{ORIGIN}/p{i:02d}", "d") for i in range(20)] + [(None, "d")], "url string, last_modified string")
    cached = spark.createDataFrame([(f"{ORIGIN}/p{i:02d}", "d" if i < 5 else "older", "old") for i in (*range(8), 90)], "url string, last_modified string, html string")
    path, log = str(tmp_path / "run"), tmp_path / "log"
    log.mkdir()

    def fetch(asked):
        urls = [r.url for r in asked.select("url").collect()]
        (log / f"{len(list(log.iterdir()))}").write_text("\n".join(urls))
        n = F.substring("url", -2, 2).cast("int")
        return asked.select("url", F.when(n == 9, 500).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.when(n == 10, "").otherwise("new").alias("html")).where(n != 11)

    def read(good):
        if "fail" in {p.name for p in tmp_path.iterdir()} and not good.where(F.col("url").endswith("p13")).isEmpty():
            raise RuntimeError("killed")
        return good.where("html <> ''")

    plan = crawl.plan(found, cached, path, limit=12, step=3)
    assert [r.url[-3:] for r in plan.orderBy("url").collect()] == [f"p{i:02d}" for i in range(5, 17)]
    (tmp_path / "fail").write_text("")
    with pytest.raises(Exception, match="killed"):
        crawl.run(spark, path, fetch, read)
    before = crawl.counts(spark, path).first().total
    (tmp_path / "fail").unlink()
    crawl.plan(found, cached, path, limit=12, step=3)
    crawl.run(spark, path, fetch, read)
    assert 0 <= before < 12 and tuple(crawl.counts(spark, path).first()) == (9, 3, 12)  # 9: status, 10: empty, 11: missing
    asked = sorted(u for f in log.iterdir() for u in f.read_text().split("\n"))
    assert len(set(asked)) == 12 and len(asked) <= 15  # only the step that broke off is asked again
    now = {r.url[-3:]: r.html for r in crawl.corpus(found, cached, path).collect()}
    assert now == {f"p{i:02d}": "old" if i < 5 else "new" for i in range(17) if i not in (9, 10, 11)}
    assert crawl.compact(found, cached, path, str(tmp_path / "v1")).count() == len(now)
    assert crawl.counts(spark, str(tmp_path / "none")).first().total == 0
