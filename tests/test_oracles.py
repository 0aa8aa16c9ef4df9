"""Every reference query whose meaning SQL can say, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lexloom.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    yield con
    con.close()


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(repr(r[i]) for i in order) for r in rows)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    found = duck.execute(SQL[name])
    expected = _rows([d[0] for d in found.description], found.fetchall())
    assert _rows(df.columns, df.collect()) == expected


MODELS = ("kmeans_cosine", "kmeans_several_k", "cluster_by_terms", "cluster_by_links", "lda_concepts", "relevance_report")


@pytest.mark.parametrize("name", MODELS)
def test_models_give_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
