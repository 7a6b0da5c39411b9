"""The registered corpus queries on the smallest tables: against SQL where there is some."""

import glob
import os

import duckdb
import pytest

from latticework.llm.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    got = sorted((tuple(r) for r in df.collect()), key=str)
    assert got
    if name in ORACLES:
        want = duck.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLES[name].strip()})").fetchall()
        assert got == sorted(want, key=str)
