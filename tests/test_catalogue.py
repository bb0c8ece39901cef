"""Every registered core query runs over the small tables; those with SQL give the rows DuckDB gives."""

import datetime
import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from sparrowdex import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


def norm(v):
    if v is None:
        return "\0"
    if isinstance(v, float | Decimal):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.6g}"
    if isinstance(v, list | tuple):
        return str([norm(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in Path("/root/testdata/sf0.001").glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in SQL:
        return
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())
