"""The registered queries over the small tables, against SQL where there is some."""

from pathlib import Path

import duckdb
import pytest

from sparrowdex.llm import queries as Q

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = Q.queries(), Q.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(map(tuple, df.select(*cols).collect()), key=str)
    assert len(set(map(str, got))) == len(got)
    if name in SQL:
        con = duckdb.connect()
        for f in Path(small).glob("*.parquet"):
            con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        rel = con.sql(SQL[name])
        at = [rel.columns.index(c) for c in cols]
        assert got == sorted((tuple(r[i] for i in at) for r in rel.fetchall()), key=str)
