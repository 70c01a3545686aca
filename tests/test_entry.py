"""Driver contract: entry, queries, oracle text; oracle agreement at sf0.001."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as E
from shelfwise.plans.catalog import ORACLE, QUERIES
from tests.conftest import SF_SMALL

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "revenue_share" in df.columns


def test_oracle_keys_are_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        out.append(tuple(
            (None if (isinstance(r[i], float) and math.isnan(r[i])) else
             (r[i].isoformat() if hasattr(r[i], "isoformat") else r[i])) for i in order))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


FAST = sorted(ORACLE)  # every query with oracle SQL, at sf0.001


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", FAST)
def test_oracle_agrees(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    res = duck.execute(ORACLE[name])
    dcols = [c[0] for c in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _canon([tuple(r) for r in df.collect()], df.columns) == _canon(res.fetchall(), dcols)
