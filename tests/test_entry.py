"""The driver contract: entry, queries, oracle_sql (checked against DuckDB on sf0.001)."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from taxomatch.plans import catalog

from conftest import SF0001

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def test_entry(spark):
    df = E.entry(spark)
    assert df.columns == ["_id", "category"]
    assert df.count() == 375


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert set(catalog.QUERIES) <= set(E.oracle_sql())


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF0001)
    cols = df.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    got = Counter(tuple(_norm(r[i]) for i in order) for r in df.collect())
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(ocols) == sorted(cols)
    oorder = sorted(range(len(ocols)), key=lambda i: ocols[i])
    want = Counter(tuple(_norm(r[i]) for i in oorder) for r in cur.fetchall())
    assert got == want
