"""Every query with SQL gives the same rows in Spark and DuckDB on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from lodestar import catalogue

SF = "/root/testdata/sf0.001"
#: Queries that SQL cannot express; their operators are held against plain versions in test_operators.py.
WITHOUT_SQL = {"greedy_modularity", "spectral_scores", "topology_importance", "pagerank_converged", "title_ratio", "scorer_training"}
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canon(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    return value


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_same_rows(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    rows = df.collect()
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert name in WITHOUT_SQL and rows and df.columns
        return
    cursor = duck.execute(sql)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted((tuple(canon(r[names.index(c)]) for c in order) for r in cursor.fetchall()), key=str)
    assert sorted((tuple(canon(r[c]) for c in order) for r in rows), key=str) == want


def test_entry(spark):
    assert catalogue.entry(spark).count() == 20
