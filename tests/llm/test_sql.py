"""The text operators' SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from locusmill.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(map(str, r)) for r in df.select(*cols).collect())
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE[name]})").fetchall()
    plain = [tuple(str(v) for v in r) for r in want]
    assert got == sorted(plain)
