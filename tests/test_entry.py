"""Every query of the engine against its SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__
from brackwater.plans.registry import ORACLE_SQL, QUERIES

TABLES = "documents embeddings pages benchmark labels conversations events".split()


@pytest.fixture(scope="module")
def tables(data):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return tuple(plain(y) for y in x)
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (int, float, np.number)):
        return None if math.isnan(x) else round(float(x), 6)
    return str(x)


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, data, tables, name):
    got = QUERIES[name](spark, data)
    want = tables.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(QUERIES) <= set(queries) and set(sql) <= set(queries)
    assert __spark_entry__.entry(spark).columns == ["domain_id", "query_id", "rank", "chunk_id", "score"]
