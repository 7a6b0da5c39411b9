"""Every registered core query runs; those with SQL agree with DuckDB."""

import glob
import os

import duckdb
import pytest

from latticework.plans import registry

@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def rows(df):
    return sorted(tuple(str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, sf_dir, duck, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.ORACLES[name]).df()[list(got.columns)]
    assert rows(got) == rows(want)


def test_queries_without_sql(spark, sf_dir):
    """What SQL can't express is compared with plain Python in test_operators; here the results' shape over whole tables."""
    left = set(registry.QUERIES) - set(registry.ORACLES)
    assert left == {"contour_tree", "split_spectral", *(f"distance_{p}_{h}" for p in ("axes", "sphere") for h in ("one", "two", "average"))}
    fore = registry.QUERIES["lattice_scan"](spark, sf_dir).where("a > 0")
    voxels, own = {r.idx for r in fore.collect()}, {r.idx for r in fore.where("a = 22").collect()}
    for name in sorted(left - {"contour_tree", "split_spectral"}):
        got = registry.QUERIES[name](spark, sf_dir).toPandas()
        assert set(got["idx"]) == voxels and (got["distance"] >= 0).all()
    assert {r.idx for r in registry.QUERIES["split_spectral"](spark, sf_dir).collect()} == own
    edges, points = registry.QUERIES["contour_tree"](spark, sf_dir), registry.QUERIES["join_tree"](spark, sf_dir)
    assert edges.count() == points.count()  # both span the same components
