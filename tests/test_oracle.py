"""Every core query with SQL gives what DuckDB makes of the SQL."""

import math
import os
from collections import Counter

import pytest

from readlake.plans import catalog, formats, problems

QUERIES = problems.QUERIES | catalog.QUERIES | formats.QUERIES
SQL = problems.SQL | catalog.SQL | formats.SQL


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.4f}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(SQL[name])
    at = [x[0] for x in cur.description]
    assert sorted(at) == cols
    assert got == Counter(tuple(plain(r[at.index(c)]) for c in cols) for r in cur.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
