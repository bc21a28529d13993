"""Every query with SQL agrees with it on the smallest tables; the others run and keep their schema."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from voltlake.plans.catalogue import CATALOGUE

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES = {n: q for n, q in entry_points.queries().items() if n in CATALOGUE}
SQL = {n: q for n, q in entry_points.oracle_sql().items() if n in QUERIES}


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


def _rows(rows, columns, order):
    places = [columns.index(c) for c in order]
    return sorted(tuple(_cell(r[i]) for i in places) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    result = db.execute(SQL[name])
    columns = [c[0] for c in result.description]
    order = sorted(df.columns)
    assert order == sorted(columns)
    assert _rows([tuple(r) for r in df.collect()], df.columns, order) == _rows(result.fetchall(), columns, order)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_model_queries_run(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() > 0
