"""Ranked search against a brute-force version, and the awkward cases."""

import math
import random
from collections import Counter

from quernstone.llm.threshold_search import SearchParams, rank_documents, terms_of
from tests.llm.data import documents, no_documents

ITEMS = "item_id long, text string, doc_id int, rank string"


def brute(docs, items, k):
    counted = [(d, Counter(terms_of((t or "").encode()))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    total, length = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in sorted(set(items), key=repr):
        scores = []
        for d, c, n in counted:
            m = 75 + (25 * n * total) // length
            s = sum(q * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(terms_of((text or "").encode())).items())
            if s > 0 and d is not None:
                scores.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_terms():
    assert terms_of("Ab-C Äb_1 x\x00y é".encode()) == ["ab".encode(), b"c", "Äb".encode(), "1 x".encode(), b"y", "é".encode()]
    assert terms_of(None) == terms_of(b"") == terms_of(b" \n-") == []


def test_equals_brute_force_with_ties_and_stretches(spark):
    r = random.Random(5)
    words = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(4000)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(1, 60)))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(60)] + [(900, docs[3][1] * 300)]  # copies tie at the last place; a long text
    items = [(i, " ".join(r.choices(words, k=12))) for i in range(12)] + [(50, docs[7][1]), (51, "w1 w1 w2 W1"), (52, "nowhere"), (53, "w1"), (53, "w1")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    want = brute(docs, items, 20)
    asked = spark.createDataFrame(items, "item_id long, text string")
    for p in (SearchParams(), SearchParams(stretch=50, step=1, block_terms=20)):
        got = sorted((tuple(x) for x in rank_documents(spark, d, asked, p).collect()), key=repr)
        assert got == want, p


def test_threshold_stops_before_the_end():
    import numpy as np

    from quernstone.llm.threshold_search import Stretch

    n = 5000
    s = Stretch.of(np.arange(n), np.full(n, 10), np.full(n, 1), np.zeros(n, np.int64), np.arange(n) % 997 + 1, np.array([3000]), n, 10 * n)
    seen = []
    look_up = Stretch.look_up
    try:
        Stretch.look_up = lambda self, docs, *rest: seen.append(len(docs)) or look_up(self, docs, *rest)
        best = s.search(np.array([0]), np.array([1]), [], 5, 4)
    finally:
        Stretch.look_up = look_up
    assert [d for _, d in best] == [996, 1993, 2990, 3987, 4984] and sum(seen) < 50


def test_awkward_rows(spark):
    items = spark.createDataFrame([(1, "ONE two", 5, "x"), (2, None, 5, "x"), (3, "", 5, "x"), (None, "word", 5, "x"), (1, "ONE two", 5, "x")], ITEMS)
    got = sorted((tuple(r) for r in rank_documents(spark, documents(spark), items).collect()), key=repr)
    plain = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    assert got == brute(plain, [(1, "ONE two"), (None, "word")], 20) and [r[:3] for r in got] == [(1, 1, 8), (1, 2, 9)]
    assert rank_documents(spark, no_documents(spark), items).count() == 0
    assert rank_documents(spark, documents(spark), items.limit(0)).count() == 0
