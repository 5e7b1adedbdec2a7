"""Every registered query with SQL against DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from quernstone.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: round(v, 3) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    rel = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in rel.description]
    want = canon(rel.fetchall(), columns)
    assert sorted(df.columns) == sorted(columns)
    assert len(got) == len(want)
    assert got == want


def test_every_query_runs(spark):
    for name in sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())):
        assert catalogue.queries()[name](spark, SF).count() > 0, name
