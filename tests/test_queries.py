"""Every core query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

import math
import os
from datetime import datetime

import duckdb
import pytest

from millrace.plans.queries import ORACLE_SQL, QUERIES


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if isinstance(x, float):
            return None if math.isnan(x) else float(f"{x:.9g}")
        return x.replace(tzinfo=None) if isinstance(x, datetime) else x

    return sorted(columns), sorted((tuple(plain(v[i]) for i in order) for v in values), key=str)


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in ORACLE_SQL:
        q = duck.execute(ORACLE_SQL[name])
        assert got == rows([c[0] for c in q.description], q.fetchall())
    else:
        assert got[1]


def test_entry(spark, data):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
