"""The registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for n in entry.queries() if n.startswith("q_")]


def _norm(v):
    return round(v, 6) if isinstance(v, float) else tuple(map(_norm, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_entry(spark):
    assert entry.entry(spark).columns == ["lang", "replaced", "surviving"]


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    found = duck.sql(f"SELECT * FROM ({sql})")
    assert sorted(found.columns) == columns
    assert got == sorted((tuple(_norm(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
