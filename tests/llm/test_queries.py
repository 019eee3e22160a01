"""Queries of the problems give the rows that their SQL gives in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from millrace.llm import mixing
from millrace.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{data}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, data, duck, name):
    if name.startswith("p7") and not os.path.exists(mixing.TOKENIZER):
        pytest.skip("no tokenizer here")
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    q = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in q.description]
    assert sorted(names) == columns
    want = sorted(tuple(row[names.index(c)] for c in columns) for row in q.fetchall())
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == want
