import corpus_pipeline
import pytest

from quernstone.llm import registry

from .data import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    item = "Which of these is it then, said one of them. The other one it was."
    docs = [(i, prose(i, 120), "en", "s", 0) for i in range(60)]
    docs += [(100 + i, prose(i, 120), "en", "s", 0) for i in range(5)]  # copies
    docs += [(200, prose(70, 50) + " " + item, "en", "s", 0), (201, prose(71, 40) + " a.b@c.org", "en", "s", 0), (202, None, None, None, None), (203, "", "en", "s", 0)]
    docs += [(300 + i, prose(80 + i, 30) + " nitwit blockhead nitwit " + prose(90 + i, 30), "en", "s", 0) for i in range(40)]
    labels = [(i, 1, int(i >= 300)) for i, *_ in docs if i < 60 or 300 <= i < 335]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_stage_takes_effect(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, folder)
        docs.write.mode("overwrite").parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.collect()})
    clean = {*range(60), *range(100, 105), 200, 201, 202, 203}
    assert kept == [clean, clean - set(range(100, 105)), clean - {*range(100, 105), 200}, clean - {*range(100, 105), 200}]
    assert "<email>" in docs.where("doc_id = 201").first().text
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == kept[-1]


def test_registry_names():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and set(registry.oracle_sql()) <= set(names)


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    docs, labels, items = "doc_id long, text string, lang string, source string, n_chars long, key binary, root long, id long, _n long, score double", "doc_id long, quality int, toxic int", "item_id long, text string"
    rows = [(1, prose(1, 90), "en", "s", 0, b"k", 1, 1, 1, 0.0), (2, prose(1, 90), "en", "s", 0, b"k", 1, 1, 1, 0.0), (2, prose(1, 90), "en", "s", 0, b"k", 1, 1, 1, 0.0), (3, None, None, None, None, None, None, None, None, None), (None, prose(2, 30), None, None, None, None, None, None, None, None), (5, "", "", "", 0, b"", 0, 0, 0, 1.0)]
    for name, some in (("empty", []), ("rows", rows)):
        d = str(tmp_path / name)
        for table, schema, data in (("documents", docs, some), ("labels", labels, []), ("benchmark", items, [])):
            spark.createDataFrame(data, schema).write.parquet(f"{d}/{table}.parquet")
        kept = spark.read.parquet(f"{d}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            kept = stage(spark, kept, d)
            kept.write.parquet(f"{d}/{k}")
            kept = spark.read.parquet(f"{d}/{k}")
            assert k == 4 or kept.columns == [c.split()[0] for c in docs.split(", ")]
        assert sorted(str(r.doc_id) for r in kept.collect()) == (["1", "3", "5", "None"] if some else [])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_take_small_batches(spark, folder, name, stage):
    """What a stage returns is computed later, so its batches have to be small then."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, 10_000)
        stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        assert int(spark.conf.get(key)) <= corpus_pipeline.BATCH
    finally:
        spark.conf.set(key, before)
