from quernstone.llm.queries import URL_RULES
from quernstone.llm.url_reputation import ReputationParams, judge_urls

SCHEMA = "page_id long, url string, host string, verdict string"


def judged(spark, rows, labels=()):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in rows], SCHEMA)
    return {r.page_id: r for r in judge_urls(pages, spark.createDataFrame(list(labels), "page_id long, bad int"), URL_RULES).collect()}


def test_parts_and_rules(spark):
    got = judged(spark, [(1, "https://WWW.Example.com/en/x?q#f"), (2, "http://a.example.com/en/"), (3, "http://example.com/fr/"), (4, "http://b.net/es/x"), (5, "http://b.net/de/x"), (6, "no scheme"), (7, None), (8, "http://example.org?x=://y/"), (9, "http://notnet/es/"), (10, "ftp://xcom/")])
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block") and (got[3].rule, got[3].verdict) == ("com/", "allow")
    assert (got[4].rule, got[4].verdict) == ("net/es/", "block") and (got[5].rule, got[5].verdict) == (None, "allow")
    assert all((got[i].host, got[i].path, got[i].rule) == ("", "", None) for i in (6, 7))
    assert (got[8].host, got[8].path) == ("example.org", "") and got[9].rule is None and got[10].rule is None


def test_reputation_shrinks_and_blocks(spark):
    rows = [(i, f"http://bad.org/{i}") for i in range(60)] + [(100 + i, f"http://good.org/{i}") for i in range(60)] + [(200, "http://once.org/")]
    labels = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(200, 1), (200, None), (None, 1), (5, 0), (999, 1)]
    got = judged(spark, rows, labels)
    assert got[3].verdict == "block" and got[130].verdict == "allow"
    assert got[200].verdict == "allow"  # one bad page is not enough
    assert got[130].bound < got[200].bound < got[3].bound


def test_hosts_without_labels_have_their_domain_or_suffix(spark):
    rows = [(i, f"http://h{i % 40}.bad.org/{i}") for i in range(400)] + [(1000 + i, f"http://good{i % 40}.net/{i}") for i in range(400)]
    rows += [(2000, "http://new.bad.org/"), (2001, "http://new.good1.net/"), (2002, "http://new.net/"), (2003, "http://new.xyz/"), (2004, None)]
    got = judged(spark, rows, [(i, 1) for i in range(400)] + [(1000 + i, 0) for i in range(400)])
    assert [got[i].verdict for i in (2000, 2001, 2002, 2003, 2004)] == ["block", "allow", "allow", "allow", "allow"]
    assert got[2002].bound < 0.1 and got[2002].bound < got[2003].bound < got[2000].bound <= got[0].bound
    assert got[2003].bound == got[2004].bound
    assert judged(spark, [(1, "http://a.org/")])[1].bound is None


def test_empty(spark):
    assert judged(spark, []) == {} and ReputationParams().block_above == 0.5
