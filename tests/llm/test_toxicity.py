import random
import zlib

import pytest

from quernstone.llm.toxicity import ToxicityParams, count_words, fit, keep_clean, score_toxicity, training_rows

from .data import documents, no_documents, prose

BAD = ["blockhead", "nitwit", "scoundrel"]


def tables(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        toxic = int(i % 4 == 0)
        w = prose(i, 60).split()
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(BAD))
        docs.append((1000 + i, " ".join(w)))
        labels.append((1000 + i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_edges(spark):
    docs, labels = tables(spark)
    every = docs.unionByName(documents(spark), allowMissingColumns=True)
    got = score_toxicity(spark, every, labels).collect()
    assert len(got) == every.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 80 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert not any(r.predicted for r in got if r.doc_id is None or r.doc_id < 20)
    assert score_toxicity(spark, no_documents(spark), labels).count() == 0
    no_labels = score_toxicity(spark, docs.limit(3), labels.limit(0)).collect()
    assert {r.score for r in no_labels} == {0.5}


@pytest.fixture(scope="module")
def model(spark):
    return fit(*tables(spark))


@pytest.mark.parametrize("text", ["b l o c k h e a d and n.i.t.w.i.t", "bl0ckhead n1tw1t", "blooockheaaad nitwit", "$coundrel bl0ckhe@d", "n!twit sc0undr3l", "NITWIT!! and BLOCKHEAD,", "s-c-o-u-n-d-r-e-l nitwiiit"])
def test_disguises_are_restored(model, text):
    assert model.score(f"{prose(5, 20)} {text} {prose(6, 20)}") >= 0.7


def test_clean_texts_stay(spark, model):
    assert all(model.score(prose(i, 100) + x) < 0.5 for i, x in enumerate(["", " a b c d e", " 10.0.0.1 x@y.z", " 3.14 (ok) wow!!"]))
    docs, labels = tables(spark)
    kept = keep_clean(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == 300


SPACED = " ".join("thisissomelongopeningofasentencethatgoesonforeverandeverbeforeitsays" + "nitwitandblockhead" + "andgoesonafterwards")


@pytest.mark.parametrize("text", [SPACED, "n" + "1" * 60 + "twit bl" + "0" * 50 + "ckhead", "n" + "i" * 70 + "twit scoun" + "d" * 45 + "rel", "what.ever.this.may.be.you.are.a.nitwit.and.a.bl0ckhead.too", "you.are.a.nitwit and/or(bl0ckhead)", "b l o" + " o" * 70 + " c k h e a d n.i.t.w.i.t"])
def test_long_disguises_are_restored(model, text):
    assert model.score(f"{prose(5, 20)} {text} {prose(6, 20)}") >= 0.7


def test_long_clean_tokens_stay(model):
    junk = random.Random(3)
    for x in ("0123456789abcdef" * 40, "".join(junk.choice("abcdefgh0123!@$") for _ in range(3000)), " ".join("thesearenothingbutlettersofasentence" * 5), "https://www.example.org/some/long/path/of/a/page-that-is-longer-than-that"):
        assert model.score(f"{prose(5, 20)} {x}") < 0.5


@pytest.mark.parametrize("params", [ToxicityParams(), ToxicityParams(broadcast_labels=5)])
def test_all_labelled_training_rows_are_learnt_from(spark, params):
    docs = spark.range(33_000).selectExpr("id as doc_id", "concat('some words ', id % 7) as text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 11 = 0 as int) as toxic")
    every = {i for i in range(33_000) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(every) > 21_000
    rows = training_rows(docs, labels, params)
    assert rows.count() == len(every) and rows.agg({"toxic": "sum"}).first()[0] == sum(i % 11 == 0 for i in every)
    n = {r.key: (r.n, r.t) for r in count_words(rows).where("not is_gram").collect()}
    assert n["words"] == (len(every), sum(i % 11 == 0 for i in every))
    grams = {r.key: r.n for r in count_words(rows).where("is_gram").collect()}
    assert grams["^^w"] == grams["ds$"] == len(every)


def test_plain_words_are_not_read(model, monkeypatch):
    """Words that no feature begins with need no reading, however many there are; what they score doesn't change."""
    empty = model.score("")
    monkeypatch.setattr(model, "of_token", lambda token: pytest.fail(f"{token} was read"))
    monkeypatch.setattr(model, "heads", {})
    words = [f"{a}{b}{c}{d}" for a in "bd" for b in "xz" for c in "qk" for d in "vw"]
    assert model.score(" ".join(f"\"{w}," for w in words)) == empty
