"""Queries against their SQL on small tables whose keys are as large as those of large tables."""

from __future__ import annotations

import random

import duckdb
from pyspark.sql import functions as F

from lodestar import catalogue
from lodestar.functions import keys
from lodestar.operators import matching


def both(spark, folder, name, **tables):
    """Rows of the query and of its SQL over ``tables``, in the order of their names of columns."""
    con = duckdb.connect()
    for table, select in tables.items():
        con.execute(f"CREATE TABLE {table} AS {select}")
        con.execute(f"COPY {table} TO '{folder}/{table}.parquet' (FORMAT parquet)")
    rows = catalogue.queries()[name](spark, f"file://{folder}")
    cursor = con.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in cursor.description]
    want = [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]
    return [sorted((tuple(r[c] for c in sorted(names)) for r in x), key=str) for x in (rows.collect(), want)]


def test_agent_candidates_tell_parts_from_suppliers(spark, tmp_path):
    lines = "SELECT * FROM (VALUES (110000, 500, 3), (110000, 500, 4), (100500, 10000, 6), (2, 7, 5)) t(l_partkey, l_suppkey, l_linenumber)"
    got, want = both(spark, tmp_path, "agent_candidates", lineitem=lines, part="SELECT * FROM (VALUES (110000, 40), (100500, 30), (100007, 50), (2, 1)) t(p_partkey, p_size)")
    assert got == want and len(got) == 3


def test_step_windows_tell_sources_apart(spark, tmp_path):
    lines = "SELECT * FROM (VALUES (1, 100004, 1), (2, 4, 1), (3, 8, 2)) t(l_orderkey, l_partkey, l_linenumber)"
    got, want = both(spark, tmp_path, "step_windows", lineitem=lines, part="SELECT * FROM (VALUES (4, 5), (8, 6), (100004, 20)) t(p_partkey, p_size)")
    assert got == want and len(got) == 3


def test_identity_keys_of_long_numbers(spark, tmp_path):
    got, want = both(spark, tmp_path, "identity_keys", part="SELECT k AS p_partkey, 'a name' AS p_name FROM range(99997, 100009) t(k)")
    assert got == want and len(got) == 12
    one = lambda x: spark.range(1).select(keys.arxiv(F.lit(x))).first()[0]
    assert [one(x) for x in ("arXiv:2001.100001v2", "https://arxiv.org/abs/2001.00001", "2001.00001", "2001.100001")] == ["2001.100001v2", "2001.00001", "2001.00001", ""]


def test_token_pairs_compare_equal_rows_once(spark, monkeypatch):
    """Copies are paired with each other and with all that their class is like; few rows meet."""
    words = [f"w{k}" for k in range(8)]
    rows = [(k, words if k % 2 else [*words[1:], words[0], words[0]]) for k in range(30)] + [(k, [*words, "x"]) for k in range(30, 50)] + [(50, ["y"]), (51, []), (52, None)]
    compared = []
    write = matching.staged
    monkeypatch.setattr(matching, "staged", lambda df, name: compared.append(name) or write(df, name))
    got = matching.token_pairs(spark.createDataFrame(rows, "k long, t array<string>"), "k", "t", 0.85)
    same = {(a, b): 1.0 for a in range(50) for b in range(a + 1, 50) if (a < 30) == (b < 30)}
    near = {(a, b): 0.9 for a in range(30) for b in range(30, 50)}
    assert {(r.a, r.b): round(r.similarity, 9) for r in got.collect()} == same | near and got.count() == len(same) + len(near)
    assert "token-classes" in compared


def test_names_in_one_pair_take_no_python(spark):
    """Names of one pair only are merged by an expression, other groups many to a call."""
    lone = [(f"item {k}", f"item {k} extra") for k in range(6)]
    names = spark.createDataFrame([(x, n) for k, pair in enumerate(lone) for x, n in zip(pair, (3, k), strict=True)], "name string, n long")
    out = matching.fuzzy_names(spark.createDataFrame(lone, "a string, b string"), names)
    assert {r.name: r.canonical for r in out.collect()} == {(b if k <= 3 else a): (a if k <= 3 else b) for k, (a, b) in enumerate(lone)}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    chains = [x for k in range(40) for x in ((f"c{k}a", f"c{k}b"), (f"c{k}b", f"c{k}c"))]
    rng = random.Random(1)
    count = {x: rng.randrange(5) for pair in chains + lone for x in pair}
    got = matching.fuzzy_names(spark.createDataFrame(chains + lone, "a string, b string"), spark.createDataFrame(list(count.items()), "name string, n long"))
    assert {r.name: r.canonical for r in got.collect()} == matching.merged_in_order(chains + lone, count)
