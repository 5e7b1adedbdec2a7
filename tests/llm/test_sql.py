"""The numbered queries that have SQL, against DuckDB."""

import duckdb
import pytest

from quernstone.llm import registry
from quernstone.llm.sql import OP10

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "documents embeddings pages labels".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    rel = duck.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    want = sorted((dict(zip(columns, r, strict=True)) for r in rel.fetchall()), key=repr)
    got = sorted(({c: r[c] for c in columns} for r in df.collect()), key=repr)
    assert set(columns) == set(df.columns) and got == want


def test_bounds_of_hosts_equal_sql(spark, duck):
    from pyspark.sql import functions as F

    from quernstone.llm.url_reputation import judge_urls

    pages, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "labels"))
    bad = F.greatest((F.col("quality") == 0).cast("int"), (F.col("toxic") == 1).cast("int"))
    got = {r.host: r.bound for r in judge_urls(pages, labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")), []).collect()}
    start = OP10[: OP10.index("ruled as (")].rstrip().rstrip(",")
    want = dict(duck.execute(f"{start} select host, low from bound").fetchall())
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-9 for h in want) and len(want) > 30
