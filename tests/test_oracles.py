"""Every core query that SQL can express against DuckDB on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from codeweft.plans import PLANS

TABLES = "region nation customer supplier part orders lineitem events documents embeddings commits commit_log authors files edges metrics class_samples eval_items".split()
QUERIES = {n: q for p in PLANS for n, q in p.QUERIES.items()}
SQL = {n: q for p in PLANS for n, q in p.SQL.items()}


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v if isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def con(data):
    if not os.path.isdir(data):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(name, spark, data, con):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    mine = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
    res = con.execute(SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert mine == Counter(tuple(norm(r[i]) for i in at) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(name, spark, data, con):
    df = QUERIES[name](spark, data)
    assert df.columns and df.count() >= 0


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)
