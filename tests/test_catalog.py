"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

from __future__ import annotations

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from sparkloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = catalog.load()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def show(x) -> str:
    if x is None or isinstance(x, float) and math.isnan(x):
        return "~"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return f"{float(x):.9g}" if isinstance(x, float) or type(x).__name__ == "Decimal" else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name].run(spark, SF)
    got = sorted(tuple(show(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if QUERIES[name].sql is None:
        assert got
        return
    rel = duck.execute(QUERIES[name].sql)
    columns = [d[0] for d in rel.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert got == sorted(tuple(show(r[i]) for i in order) for r in rel.fetchall())


def test_entry_and_contract(spark):
    assert entry.entry(spark).count() == 20
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert set(QUERIES) <= set(names)
