import itertools
import math
import random
from collections import Counter

import numpy as np

from quernstone.llm.decontamination import Index, LeakParams, Statistics, drop_leaks, find_leaks, ngrams, parts, words

from .data import documents, no_documents, prose


def items():
    return [(i, prose(500 + i, 12).capitalize() + ". " + prose(700 + i, 10).capitalize() + ".") for i in range(60)]


def whole(own, params=LeakParams()):
    lists = [words(t) for _, t in own]
    df = Counter(t for w in lists for t in set(w))
    return Index(own, df, Statistics(len(lists), sum(map(len, lists)), max(map(len, lists))), params)


def test_wand_equals_exhaustive_search():
    r, impacts = random.Random(0), [own_impacts(t) for _, t in items()]
    for block, threshold in itertools.product((1, 4, 64), (0.05, 0.1, 0.2, 0.4)):
        index = whole(items(), LeakParams(block=block, threshold=threshold))
        queries = [sorted(r.sample(range(len(index.terms)), r.choice((0, 3, 30, 150)))) for _ in range(50)]
        owner, term = np.repeat(np.arange(50), [len(q) for q in queries]), np.array([t for q in queries for t in q], dtype=np.int64)
        names, want = list(index.terms), set()
        for p, q in enumerate(queries):
            asked = {names[t] for t in q}
            want |= {(p, d) for d, own in enumerate(impacts) if sum(x for t, x in own.items() if t in asked) >= threshold}
        assert set(zip(*map(np.ndarray.tolist, index.search(owner, term, 50)), strict=True)) == want


def own_impacts(text, k1=1.2, b=0.75):
    """BM25 shares of an item, straight from the formula."""
    lists = [words(t) for _, t in items()]
    mean, own = sum(map(len, lists)) / len(lists), words(text)
    idf = {t: math.log(1 + (len(lists) - (n := sum(t in w for w in lists)) + 0.5) / (n + 0.5)) for t in set(own)}
    score = {t: idf[t] * own.count(t) * (k1 + 1) / (own.count(t) + k1 * (1 - b + b * len(own) / mean)) for t in idf}
    whole_score = sum(score.values())
    return {t: x / whole_score for t, x in score.items()}


def test_end_to_end_against_exhaustive_scores(spark):
    """Every item in every window of every text, scored one by one, whatever the shards."""
    r, own = random.Random(3), items()
    rows = []
    for i in range(120):  # parts of items of all sizes, some with words put in
        w = own[i % 60][1].split()
        keep = w[: r.randint(len(w) // 3, len(w))]
        for _ in range(r.choice((0, 0, 2, 6))):
            keep.insert(r.randrange(len(keep)), r.choice(prose(999, 50).split()))
        rows.append((i, f"{prose(i, r.choice((0, 15, 90)))} {' '.join(keep)} {prose(i + 50, r.choice((0, 15, 90)))}"))
    impacts, longest = {i: own_impacts(t) for i, t in own}, max(len(words(t)) for _, t in own)
    want = set()
    for doc, text in rows:
        tokens = words(text)
        for low in range(0, max(1, len(tokens) - longest), longest):
            window = tokens[low : low + 2 * longest]
            have = set(window)
            for i, t in own:
                if sum(x for k, x in impacts[i].items() if k in have) >= 0.5:
                    share = [len(p & ngrams(window, 3)) / len(p) for p in (ngrams(x, 3) for x in parts(t))]
                    if min(share) >= 0.6:
                        want.add((doc, i))
    docs, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(own, "item_id long, text string")
    assert 20 < len(want) < 110
    for params in (LeakParams(), LeakParams(shard=20), LeakParams(shard=7, resident=2), LeakParams(shard=1_000, block=64)):
        assert {(x.doc_id, x.item_id) for x in find_leaks(spark, docs, tests, params).collect()} == want


def test_leaks_are_found_and_clean_texts_are_not(spark):
    own = items()
    rows = [(i, prose(i, 150)) for i in range(40)]
    rows += [(100 + i, f"{prose(i, 90)} {own[i][1].upper()} {prose(i + 50, 200)}") for i in range(60)]
    rows += [(300, own[3][1]), (301, own[4][1] + "\n" + own[5][1]), (302, own[6][1].split(". ")[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(documents(spark), allowMissingColumns=True)
    tests = spark.createDataFrame([*own, (900, None), (901, ""), (None, "x y z")], "item_id long, text string")
    want = {(100 + i, i) for i in range(60)} | {(300, 3), (301, 4), (301, 5)}
    for params in (LeakParams(), LeakParams(shard=20)):
        got = find_leaks(spark, docs, tests, params).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = drop_leaks(spark, docs, tests)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 62
    assert find_leaks(spark, no_documents(spark), tests).count() == 0
    assert find_leaks(spark, docs, tests.limit(0)).count() == 0


def test_words_and_parts():
    assert words("A-b, C! -- é9") == ["ab", "c", "é9"]
    assert parts("One two. Three?") == (["one", "two"], ["three"])
    assert parts("a b c") == (["a", "b"], ["c"]) and parts("") == ([], [])
