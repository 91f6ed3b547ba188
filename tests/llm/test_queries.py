"""Registered training-data queries against DuckDB and their contracts on the smallest tables."""

import os
import zlib

import duckdb
import pandas as pd
import pytest

from clinicweave.llm.oracles import ORACLES
from clinicweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    plain = lambda df: sorted((tuple(None if pd.isna(x) else x for x in r) for r in df[columns].astype(object).values.tolist()), key=repr)
    assert columns == sorted(want.columns) and plain(got) == plain(want)


@pytest.mark.parametrize(("name", "by", "rest"), [("op2_language_id", 4, 2), ("op3_toxicity", 3, 1), ("op9_quality", 3, 1)])
def test_every_document_is_scored(spark, name, by, rest):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % by == rest) for i, h in zip(got.doc_id, got.held_out))
