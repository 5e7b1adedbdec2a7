import math
import zlib
from collections import Counter

import numpy as np

from quernstone.llm.ppm import PpmParams, gram_keys, level, log_probabilities, low_levels, score_texts

from .data import documents, no_documents, prose


def base(rows):
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c, ends = Counter(), 0
    for i, t in rows:
        if i is None or not held[i]:
            c.update((t or "").encode().lower().split())
            ends += 1
    n = sum(c.values()) + ends
    scale = n + 0.1 * (len(c) + 1 + 1)
    log = lambda k: math.log10((k + 0.1) / scale)
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, False if i is None else held[i], len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(sum(log(c[x]) for x in w) + log(ends), 6)))
    return out


def test_base_against_brute_force(spark):
    docs = documents(spark).unionByName(spark.createDataFrame([(100 + i, prose(i, 60)) for i in range(40)], "doc_id long, text string"), allowMissingColumns=True)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for params in (PpmParams(), PpmParams(head=5, flush=20)):
        got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in score_texts(spark, docs.repartition(3), params).collect()]
        key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(got, key=key) == sorted(base(rows), key=key)
    assert score_texts(spark, no_documents(spark)).count() == 0


def test_levels_are_distributions():
    data = b"the cat and the hat and the bat " * 20
    key = gram_keys([data])[0]
    gram, n = np.unique(key, return_counts=True)
    levels = low_levels(gram, n.astype(float))
    for order in range(3, 6):
        levels.append(level(gram, n.astype(float), order, levels[-1]))
    for context in (b"the c", b"zzzzz", b"d the", b"\n\n\n\n\n"):
        every = np.array([int.from_bytes(context + bytes([x])) for x in range(256)])
        assert abs((10 ** log_probabilities(every, levels)).sum() - 1) < 1e-9


def test_scores_follow_the_language(spark):
    rows = [(i, prose(i, 200, 60)) for i in range(30)] + [(99, "zzzz qqqq xxxx " * 60)]
    got = {r.doc_id: r.score / r.n_tokens for r in score_texts(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[99] < min(got[i] for i in range(30)) or zlib.crc32(b"99") % 10
    assert all(s < 0 for s in got.values())


def byte_model(texts):
    """log10 of a byte after its context, straight from the definition: method D, exclusion, five context bytes to none."""
    counts = {}
    for t in texts:
        b = b"\n" * 5 + t + b"\xff"
        for i in range(5, len(b)):
            for k in range(6):
                counts.setdefault(b[i - k : i], Counter())[b[i]] += 1

    def p(context, symbol):
        below = (lambda x: p(context[1:], x)) if context else (lambda x: 1 / 256)
        c = counts.get(context)
        if not c:
            return below(symbol)
        if symbol in c:
            return (c[symbol] - 0.5) / sum(c.values())
        return len(c) / (2 * sum(c.values())) * below(symbol) / (1 - sum(map(below, c)))

    return lambda t: sum(math.log10(p((b := b"\n" * 5 + t + b"\xff")[i - 5 : i], b[i])) for i in range(5, len(t) + 6))


def test_score_against_the_definition_in_all_scripts(spark):
    latin = [prose(i, 40) + " ÀÉÎÕÜ 0123456789 ~!@#$%^&*()_+{}|:<>?[];',./-=" for i in range(12)]
    other = [f"слово мир и снег {i} δρόμος λόγος 漢字 仮名" for i in range(12)]
    rows = [*enumerate([*latin, *other, "", None]), (207, "снег и слово"), (213, "оволс и генс")]  # the last two are held out
    model = byte_model([(t or "").encode().lower() for i, t in rows if zlib.crc32(str(i).encode()) % 10])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for params in (PpmParams(), PpmParams(head_grams=7, flush=20), PpmParams(head_grams=0)):
        got = {r.doc_id: r.score for r in score_texts(spark, docs, params).collect()}
        assert all(abs(got[i] - model((t or "").encode().lower())) < 1e-6 for i, t in rows)


def test_other_scripts_are_learnt_beside_a_hot_one(spark):
    hot = " ".join(chr(c) for c in range(33, 127)) + " "
    rows = [*((i, hot * 20) for i in range(20)), *((100 + i, "снег и слово мир ") for i in range(20)), (207, "слово и снег"), (213, "оволс и генс")]  # the last two are held out
    got = {r.doc_id: r.score for r in score_texts(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[207] > got[213] + 5


def test_open_ngrams_of_a_block_are_arrays():
    import random
    import tracemalloc

    from quernstone.llm.ppm import score_head

    r = random.Random(4)
    texts = [bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in (60_000, 0, 40_000)]
    key, sizes = gram_keys(texts)
    tracemalloc.start()
    scores, many, grams, times = score_head(texts, np.zeros(0, np.int64), np.zeros(0))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 40 * len(key) and not scores.any() and many.sum() == len(grams) == len(times)
    at = np.cumsum([0, *sizes])
    for i, (a, b) in enumerate(zip(np.cumsum([0, *many[:-1]]), np.cumsum(many))):
        assert dict(zip(grams[a:b].tolist(), times[a:b].tolist())) == Counter(key[at[i] : at[i + 1]].tolist())
