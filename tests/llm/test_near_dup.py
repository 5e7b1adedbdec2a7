import random
from itertools import combinations

from pyspark.sql import functions as F

from quernstone.llm.graph import components
from quernstone.llm.near_dup import NearDupParams, duplicate_groups, keep_first, shingles, text_key

from .data import documents, no_documents, prose


def sets(text):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    s = {i: sets(t) for i, t in rows}
    for a, b in combinations(s, 2):
        inter = len(s[a] & s[b])
        if s[a] and s[b] and 100 * inter >= 75 * (len(s[a]) + len(s[b]) - inter):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s[i]), find(i)) for i in s}


def test_against_brute_force(spark):
    r = random.Random(1)
    rows = []
    for g in range(6):  # families that spread around the threshold
        base = prose(100 + g, r.choice((4, 12, 60, 200))).split()
        for _ in range(r.choice((2, 12, 40))):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(("x", "Y", "zz"))
            rows.append((len(rows) * 3 % 509, " ".join(w)))
    rows += [(600 + i, prose(900 + i, 50)) for i in range(30)]
    want = brute(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    deep = {r.doc_id: (r.n_shingles, r.component_id) for r in duplicate_groups(spark, docs, NearDupParams(region=6)).collect()}  # crowded regions go deeper
    assert all(want[c][1] == want[i][1] for i, (_, c) in deep.items()) and sum(deep[i] == want[i] for i in want) >= 0.95 * len(want)
    for params in (NearDupParams(), NearDupParams(region=6, depth=3)):  # at full depth they are dealt into cells, and all is compared
        got = duplicate_groups(spark, docs, params).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edges(spark):
    docs = documents(spark)
    got = duplicate_groups(spark, docs)
    rows = got.collect()
    assert len(rows) == docs.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[2].component_id == by_id[3].component_id == 1 and by_id[1].kept
    assert all(by_id[i].component_id == i and by_id[i].n_shingles == 0 and by_id[i].kept for i in (5, 6, 7))
    assert by_id[9].component_id == 8  # case and spacing don't count
    assert sorted((r.component_id or 0, r.kept) for r in rows if r.doc_id is None) == [(0, True), (1, False)]
    assert duplicate_groups(spark, no_documents(spark)).count() == 0
    kept = keep_first(spark, docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(by_id) - {2, 3, 9} | {None}
    assert sum(r.doc_id is None for r in kept.collect()) == 1  # the row without doc_id and with a text that another has goes


def test_rows_that_repeat_a_doc_id_go_by_their_own_texts(spark):
    a, b = prose(1, 80), prose(2, 80)
    near = lambda t: t.replace(t.split()[40], "changed", 1)
    rows = [(1, a), (1, b), (2, near(b)), (3, near(a)), (5, prose(3, 70)), (5, a + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in duplicate_groups(spark, docs).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (5, 1), (5, 5)]
    assert {(r.doc_id, r.text) for r in keep_first(spark, docs).collect()} == {(1, a), (1, b), (5, prose(3, 70))}


def test_recall_on_a_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in duplicate_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked = [i for i, (_, c) in want.items() if c != i]
    assert len(linked) > 50 and sum(got[i] == want[i] for i in linked) >= 0.99 * len(linked)
    assert all(got[i] == want[i] for i in want if i not in linked)


def test_keys_are_the_same_in_both_forms(spark):
    texts = ["A b", " a\tB\n", "\x0bÄ é\x0c", "", " ", None, "\u2003x \U0001f600", "x" * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", text_key(F.col("text")).alias("k")).collect()
    assert all((None if r.k is None else bytes(r.k)) == shingles(r.text, 5)[1] for r in rows)


def test_shingles_of_short_texts():
    assert len(shingles("a b", 5)[0]) == 1 and len(shingles("a b c d e f", 5)[0]) == 2 and shingles(" ", 5)[1] is None


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 200 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {200 + i: 100 for i in range(30)}


def test_texts_and_sets_come_in_small_batches(spark, monkeypatch):
    from quernstone.llm import near_dup

    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before, write = spark.conf.get(name), near_dup.materialize
    monkeypatch.setattr(near_dup, "materialize", lambda s, df, tag: (seen.append((tag, int(s.conf.get(name)))), write(s, df, tag))[1])
    rows = [(i, f"one two three four five six seven eight {i // 2}") for i in range(12)]
    got = near_dup.duplicate_groups(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0, 2, 4, 6, 8, 10} and spark.conf.get(name) == before
    assert {"signed", "sets", "confirmed"} <= {tag for tag, n in seen if n <= 1024}
    assert all(n <= 1024 for tag, n in seen if tag in ("signed", "info", "sets", "open", "confirmed"))
