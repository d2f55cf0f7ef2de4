"""Betweenness is of all shortest paths, not of those from a part of the nodes."""

from __future__ import annotations

from itertools import combinations

from lodestar import catalogue


def test_query_counts_paths_between_all_nodes(spark, tmp_path):
    """Parts 1, 2, 3 (none divisible by 20) and suppliers 0, 1 in a path 1 - s0 - 2 - s1 - 3."""
    rows = [(1, 0), (2, 0), (2, 1), (3, 1)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.u, r.v): r.betweenness for r in catalogue.queries()["betweenness"](spark, str(tmp_path)).collect()}
    path, want = [1, -1, 2, -2, 3], {}
    for a, b in combinations(range(5), 2):
        for k in range(a, b):
            pair = min(path[k], path[k + 1]), max(path[k], path[k + 1])
            want[pair] = want.get(pair, 0) + 2 / 20 * 1000
        for k in range(a + 1, b):
            want[path[k], path[k]] = want.get((path[k], path[k]), 0) + 2 / 12 * 1000
    assert {k: round(x, 2) for k, x in got.items() if x} == {k: round(x, 2) for k, x in want.items()}
