"""The queries that have SQL against it, on the smallest tables."""

import os

import duckdb
import pytest

from brackwater.llm.registry import ORACLE_SQL, QUERIES


def plain(x):
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, data, name):
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        path = f"{data}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    got = QUERIES[name](spark, data)
    want = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    found = got.select(*columns).collect()
    assert sorted(map(repr, map(plain, map(tuple, found)))) == sorted(map(repr, map(plain, want.fetchall())))
