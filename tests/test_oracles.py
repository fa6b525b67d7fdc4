"""Every registered query with an SQL oracle must equal DuckDB on the same tables
(order-insensitive, columns matched by name). Run at sf0.001 for speed; the
driver repeats this at sf0.01."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as E
from tallyspark.sources.tables import TABLES

SF = os.environ.get("TALLY_TEST_SF", "/root/testdata/sf0.001")
SQL = E.oracle_sql()
QUERIES = E.queries()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return v


def _canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_is_registered_with_a_doc():
    assert len(QUERIES) >= 60
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(SQL[name])
    ocols = [d[0] for d in cur.description]
    assert _canon(df.columns, rows) == _canon(ocols, cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_oracle_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["system", "variant", "passes", "items", "rate"]
    assert df.count() == 60
