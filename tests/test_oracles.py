"""Every registered query that has SQL gives the same rows as DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.QUERIES[name](spark, SF).toPandas(), con.sql(entry.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    plain = lambda df: sorted((tuple(None if x != x or x is None else float(x) if isinstance(x, (int, float)) else str(x) for x in r) for r in df[columns].astype(object).values.tolist()), key=repr)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or isinstance(u, float) and isinstance(v, float) and abs(u - v) < 1e-5 for u, v in zip(x, y)), (x, y)
