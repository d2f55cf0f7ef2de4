"""Queries over graphs: parts bought together, parts and suppliers, users and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.operators import communities as C
from lodestar.operators import graph as G
from lodestar.operators import links as L
from lodestar.plans.registry import query, table

# Parts of one order are linked; an order has at most seven lines, so its pairs are bounded.
BASKET_SQL = "basket AS (SELECT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2), both_ways AS (SELECT src, dst, weight FROM basket UNION ALL SELECT dst, src, weight FROM basket), deg AS (SELECT src AS node, count(*) AS degree, sum(weight) AS strength FROM both_ways GROUP BY src)"
# All parts and the suppliers that ship them; a search starts from the parts whose key is divisible by 20.
SHIPPED_SQL = "shipped AS MATERIALIZED (SELECT DISTINCT l_partkey AS src, -l_suppkey - 1 AS dst FROM lineitem), ways AS MATERIALIZED (SELECT src, dst FROM shipped UNION ALL SELECT dst, src FROM shipped), sources AS (SELECT DISTINCT src FROM shipped WHERE src % 20 = 0)"
#: Levels that the SQL of searches spells out; parts and suppliers are at most so far apart.
LEVELS = 6


def _level_sql(levels: int = LEVELS) -> str:
    steps = ["l0 AS MATERIALIZED (SELECT src AS source, src AS node, CAST(1 AS DOUBLE) AS paths FROM sources)"]
    for k in range(1, levels + 1):
        seen = " AND ".join(f"NOT EXISTS (SELECT 1 FROM l{j} s WHERE s.source = x.source AND s.node = x.node)" for j in range(max(0, k - 2), k))
        steps.append(f"l{k} AS MATERIALIZED (SELECT * FROM (SELECT l.source, w.dst AS node, sum(l.paths) AS paths FROM l{k - 1} l JOIN ways w ON l.node = w.src GROUP BY 1, 2) x WHERE {seen})")
    return ", ".join(steps)


def _dependency_sql(levels: int = LEVELS) -> str:
    steps = [f"s{levels} AS MATERIALIZED (SELECT source, node, paths, 0.0::DOUBLE AS share FROM l{levels})"]
    for k in range(levels, 0, -1):
        steps.append(f"h{k} AS MATERIALIZED (SELECT b.source, b.node AS v, a.node AS u, a.paths / b.paths * (1 + b.share) AS part FROM s{k} b JOIN ways w ON b.node = w.src JOIN l{k - 1} a ON a.source = b.source AND a.node = w.dst)")
        steps.append(f"s{k - 1} AS MATERIALIZED (SELECT l.source, l.node, l.paths, coalesce(g.share, 0) AS share FROM l{k - 1} l LEFT JOIN (SELECT source, u, sum(part) AS share FROM h{k} GROUP BY 1, 2) g ON g.source = l.source AND g.u = l.node)")
    ends = " UNION ALL ".join([f"SELECT least(u, v) AS u, greatest(u, v) AS v, part FROM h{k}" for k in range(1, levels + 1)] + [f"SELECT node, node, share FROM s{k}" for k in range(1, levels)])
    return ", ".join(steps) + f", ends AS (SELECT u, v, sum(part) AS dependency FROM ({ends}) GROUP BY 1, 2), sizes AS (SELECT (SELECT count(DISTINCT src) FROM ways) AS n, (SELECT count(*) FROM sources) AS k)"


def _basket(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("na"), F.col("l_partkey").alias("src"))
    b = lines.select("l_orderkey", F.col("l_linenumber").alias("nb"), F.col("l_partkey").alias("dst"))
    return G.undirected(a.join(b, "l_orderkey").where("na < nb").select("src", "dst"))


def _shipped(spark, sf_dir):
    """All parts and the suppliers that ship them."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).distinct().withColumn("weight", F.lit(1).cast("long"))


@query("copurchase_edges", f"WITH {BASKET_SQL} SELECT src, dst, weight FROM basket")
def copurchase_edges(spark, sf_dir):
    return _basket(spark, sf_dir)


@query("degree_centrality", f"WITH {BASKET_SQL} SELECT node, degree, round(degree / ((SELECT count(*) FROM deg) - 1), 6) AS centrality FROM deg")
def degree_centrality(spark, sf_dir):
    return G.degree_centrality(_basket(spark, sf_dir)).select("node", "degree", F.round("centrality", 6).alias("centrality"))


@query("graph_summary", f"WITH {BASKET_SQL}, s AS (SELECT count(*) AS n_nodes, CAST(sum(degree) / 2 AS BIGINT) AS n_edges FROM deg) SELECT n_nodes, n_edges, round(2.0 * n_edges / (n_nodes * (n_nodes - 1)), 6) AS density, round(2.0 * n_edges / n_nodes, 6) AS mean_degree FROM s")
def graph_summary(spark, sf_dir):
    return G.summary(_basket(spark, sf_dir)).select("n_nodes", "n_edges", F.round("density", 6).alias("density"), F.round("mean_degree", 6).alias("mean_degree"))


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT node, 1.0 / (SELECT count(*) FROM deg) AS rank FROM deg)"]
    for k in range(rounds):
        steps.append(f"r{k + 1} AS (SELECT b.dst AS node, 0.15 / (SELECT count(*) FROM deg) + 0.85 * sum(b.weight / d.strength * r.rank) AS rank FROM both_ways b JOIN deg d ON b.src = d.node JOIN r{k} r ON b.src = r.node GROUP BY b.dst)")
    return f"WITH {BASKET_SQL}, {', '.join(steps)} SELECT node, round(rank, 9) * 1000 AS rank FROM r{rounds}"


@query("pagerank_10", _pagerank_sql(10))
def pagerank_10(spark, sf_dir):
    return G.pagerank(_basket(spark, sf_dir), rounds=10, tolerance=0).select("node", (F.round("rank", 9) * 1000).alias("rank"))


def _directed_rank_sql(rounds: int) -> str:
    steps = ["outs AS MATERIALIZED (SELECT dst AS node, count(*) AS n FROM shipped GROUP BY 1), nodes AS MATERIALIZED (SELECT DISTINCT src AS node FROM ways), size AS (SELECT count(*) AS n FROM nodes), q0 AS MATERIALIZED (SELECT node, 1.0 / n AS rank FROM nodes, size)"]
    for k in range(rounds):
        steps.append(f"z{k} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS lost FROM q{k} WHERE node NOT IN (SELECT node FROM outs)), g{k} AS (SELECT s.src AS node, sum(r.rank / o.n) AS got FROM shipped s JOIN outs o ON s.dst = o.node JOIN q{k} r ON r.node = s.dst GROUP BY 1)")
        steps.append(f"q{k + 1} AS MATERIALIZED (SELECT nodes.node, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS rank FROM nodes LEFT JOIN g{k} g ON nodes.node = g.node, z{k}, size)")
    return f"WITH {SHIPPED_SQL}, {', '.join(steps)} SELECT node, round(rank, 9) * 1000 AS rank FROM q{rounds}"


@query("pagerank_directed", _directed_rank_sql(20))
def pagerank_directed(spark, sf_dir):
    """Suppliers to parts, directed: parts give their rank to all nodes alike."""
    rows = _shipped(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
    return G.pagerank(rows, rounds=20, directed=True, tolerance=0).select("node", (F.round("rank", 9) * 1000).alias("rank"))


@query("pagerank_converged")
def pagerank_converged(spark, sf_dir):
    """Parts bought together, until the ranks hardly change."""
    return G.pagerank(_basket(spark, sf_dir)).select("node", (F.round("rank", 9) * 1000).alias("rank"))


@query("directed_degrees", f"WITH {SHIPPED_SQL}, n AS (SELECT count(DISTINCT src) - 1 AS n FROM ways), o AS (SELECT src AS node, count(*) AS c FROM shipped GROUP BY 1), i AS (SELECT dst AS node, count(*) AS c FROM shipped GROUP BY 1) SELECT coalesce(o.node, i.node) AS node, coalesce(i.c, 0) AS in_degree, coalesce(o.c, 0) AS out_degree, round(coalesce(i.c, 0) / n, 6) AS in_centrality, round(coalesce(o.c, 0) / n, 6) AS out_centrality FROM o FULL JOIN i ON o.node = i.node, n")
def directed_degrees(spark, sf_dir):
    return G.directed_centrality(_shipped(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("in_centrality", "out_centrality")})


@query("mixed_edges", """WITH r AS (SELECT l_suppkey AS src, l_partkey % 50 AS dst, l_quantity AS weight, l_returnflag <> 'R' AS directed, l_orderkey * 10 + l_linenumber AS pos FROM lineitem)
SELECT least(src, dst) AS src, greatest(src, dst) AS dst, arg_max(weight, pos) AS weight, false AS directed FROM r GROUP BY 1, 2""")
def mixed_edges(spark, sf_dir):
    """Returned lines give undirected edges, so all become undirected; the last of parallel edges counts."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % 50).alias("dst"), F.col("l_quantity").alias("weight"), (F.col("l_returnflag") != "R").alias("directed"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"))
    return G.simple(rows)


def _successions(spark, sf_dir):
    """Orders that follow each other of one customer: a path per customer."""
    from pyspark.sql import Window as W

    after = F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), after.alias("dst")).where("dst IS NOT NULL")
    return G.undirected(rows)


@query("connected_components", "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def connected_components(spark, sf_dir):
    return G.components(_successions(spark, sf_dir))


@query("graph_structure", f"""WITH {BASKET_SQL}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM basket a JOIN basket b ON a.dst = b.src JOIN basket c ON c.src = a.src AND c.dst = b.dst),
n AS (SELECT node, count(*) AS triangles FROM (SELECT x AS node FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY node), loops AS (SELECT count(DISTINCT a.l_partkey) AS self_loops FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey = b.l_partkey)
SELECT (SELECT count(*) FROM deg) AS n_nodes, (SELECT count(*) FROM basket) AS n_edges, self_loops, 1 AS n_components, (SELECT count(*) FROM deg) AS largest_component, (SELECT round(avg(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END), 6) FROM deg LEFT JOIN n ON deg.node = n.node) AS average_clustering FROM loops""")
def graph_structure(spark, sf_dir):
    """Parts bought together: all of them hang together."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    pairs = lines.toDF("o", "na", "src").join(lines.toDF("o", "nb", "dst"), "o").where("na < nb").select("src", "dst")
    return G.structure(pairs).withColumn("average_clustering", F.round("average_clustering", 6))


@query("triangles_and_clustering", f"""WITH {BASKET_SQL}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM basket a JOIN basket b ON a.dst = b.src JOIN basket c ON c.src = a.src AND c.dst = b.dst),
n AS (SELECT node, count(*) AS triangles FROM (SELECT x AS node FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY node)
SELECT deg.node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS clustering FROM deg LEFT JOIN n ON deg.node = n.node""")
def triangles_and_clustering(spark, sf_dir):
    return G.triangles(_basket(spark, sf_dir)).select("node", "degree", "triangles", F.round("clustering", 6).alias("clustering"))


def _core_sql(rounds: int) -> str:
    steps = ["c0 AS MATERIALIZED (SELECT src AS node, count(*) AS core FROM ways GROUP BY 1)"]
    for k in range(rounds):
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT node, max(least(value, reach)) AS core FROM (SELECT node, value, sum(n) OVER (PARTITION BY node ORDER BY value DESC) AS reach FROM (SELECT w.src AS node, least(a.core, b.core) AS value, count(*) AS n FROM ways w JOIN c{k} a ON a.node = w.src JOIN c{k} b ON b.node = w.dst GROUP BY 1, 2)) GROUP BY node)")
    return f"WITH {SHIPPED_SQL}, {', '.join(steps)} SELECT node, CAST(core AS BIGINT) AS core FROM c{rounds}"


@query("core_numbers", _core_sql(40))
def core_numbers(spark, sf_dir):
    return G.core_numbers(_shipped(spark, sf_dir))


def _label_sql(rounds: int) -> str:
    steps = ["p0 AS MATERIALIZED (SELECT DISTINCT src AS node, src AS community FROM both_ways)"]
    for k in range(rounds):
        steps.append(f"p{k + 1} AS MATERIALIZED (SELECT node, community FROM (SELECT b.src AS node, p.community, sum(b.weight) AS votes FROM both_ways b JOIN p{k} p ON b.dst = p.node GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY node ORDER BY votes DESC, community) = 1)")
    return ", ".join(steps)


@query("label_propagation_5", f"WITH {BASKET_SQL}, {_label_sql(5)} SELECT node, community FROM p5")
def label_propagation_5(spark, sf_dir):
    return G.label_propagation(_basket(spark, sf_dir), rounds=5)


@query("modularity_of_brands", f"""WITH {BASKET_SQL}, own AS (SELECT p_partkey AS node, p_brand AS community FROM part), m AS (SELECT sum(weight) AS m FROM basket),
i AS (SELECT s.community, sum(weight) AS inside FROM basket b JOIN own s ON b.src = s.node JOIN own d ON b.dst = d.node WHERE s.community = d.community GROUP BY 1),
k AS (SELECT community, sum(strength) AS strength FROM deg JOIN own ON deg.node = own.node GROUP BY 1)
SELECT round(sum(coalesce(inside, 0) / m - power(strength / (2 * m), 2)), 6) AS modularity FROM k LEFT JOIN i ON k.community = i.community, m""")
def modularity_of_brands(spark, sf_dir):
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    return G.modularity(_basket(spark, sf_dir), own).select(F.round("modularity", 6).alias("modularity"))


def _sources(edges):
    return edges.where("src >= 0 AND src % 20 = 0").select(F.col("src").alias("node")).distinct()


@query("hop_distances", f"WITH {SHIPPED_SQL}, {_level_sql(3)} " + " UNION ALL ".join(f"SELECT source, node, {k} AS distance FROM l{k}" for k in range(4)))
def hop_distances(spark, sf_dir):
    edges = _shipped(spark, sf_dir)
    return G.distances(edges, _sources(edges), hops=3)


PRICED_SQL = "priced AS MATERIALIZED (SELECT l_partkey AS src, -l_suppkey - 1 AS dst, min(l_quantity) AS weight FROM lineitem GROUP BY 1, 2), pw AS MATERIALIZED (SELECT src, dst, weight FROM priced UNION ALL SELECT dst, src, weight FROM priced)"


@query("weighted_distances", f"WITH {PRICED_SQL}, d0 AS (SELECT DISTINCT src AS source, src AS node, 0.0 AS distance FROM priced WHERE src % 20 = 0)" + "".join(f", d{k} AS MATERIALIZED (SELECT source, node, min(distance) AS distance FROM (SELECT * FROM d{k - 1} UNION ALL SELECT source, dst, distance + weight FROM d{k - 1} JOIN pw ON node = src) GROUP BY 1, 2)" for k in (1, 2, 3)) + " SELECT source, node, CAST(distance AS DOUBLE) AS distance FROM d3")
def weighted_distances(spark, sf_dir):
    """Cheapest ways of at most three shipments, a shipment weighing the least quantity of its pair."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).agg(F.min(F.col("l_quantity").cast("double")).alias("weight"))
    return G.weighted_distances(rows, _sources(rows), hops=3)


@query("directed_paths", f"""WITH {SHIPPED_SQL}, p AS (SELECT a.src AS source, b.dst AS target, 2 AS hops, a.src || '>' || a.dst || '>' || b.dst AS path, row_number() OVER (PARTITION BY a.src, b.dst ORDER BY a.dst) AS place FROM ways a JOIN ways b ON a.dst = b.src WHERE a.src >= 0 AND a.src % 20 = 0 AND b.dst >= 0 AND b.dst % 20 = 0 AND a.src <> b.dst)
SELECT source, target, CAST(place AS INT) AS place, CAST(hops AS BIGINT) AS hops, path FROM p WHERE place <= 20""")
def directed_paths(spark, sf_dir):
    """Between any two of the stated parts, over a supplier of both."""
    edges = _shipped(spark, sf_dir)
    out = G.paths(G.both_ways(edges), _sources(edges), _sources(edges), hops=2)
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), ">"))


EVERY_SQL = SHIPPED_SQL.replace("SELECT DISTINCT src FROM shipped WHERE src % 20 = 0", "SELECT DISTINCT src FROM ways")


@query("betweenness", f"WITH {EVERY_SQL}, {_level_sql()}, {_dependency_sql()} SELECT u, v, round(dependency * n / k / CASE WHEN u = v THEN (n - 1.0) * (n - 2) ELSE n * (n - 1.0) END, 8) * 1000 AS betweenness FROM ends, sizes")
def betweenness(spark, sf_dir):
    """Of all parts, suppliers and shipments, over the shortest paths between all of them."""
    return G.betweenness(_shipped(spark, sf_dir)).select("u", "v", (F.round("betweenness", 8) * 1000).alias("betweenness"))


@query("yearly_snapshots", """WITH e AS (SELECT a.l_partkey AS src, -a.l_suppkey - 1 AS dst, CAST(year(o_orderdate) AS INT) AS year FROM lineitem a JOIN orders ON l_orderkey = o_orderkey), y AS (SELECT src, dst, year, count(*) AS weight FROM e GROUP BY ALL)
SELECT src, dst, year, weight, sum(weight) OVER (PARTITION BY src, dst ORDER BY year) AS total FROM y""")
def yearly_snapshots(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    rows = lines.join(orders, "l_orderkey").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"), "year")
    return G.yearly_snapshots(rows)


@query("snapshot_features", """WITH e AS (SELECT DISTINCT l_partkey AS src, -l_suppkey - 1 AS dst, CAST(year(l_shipdate) AS INT) AS year FROM lineitem), w AS MATERIALIZED (SELECT src AS node, dst AS other, year FROM e UNION ALL SELECT dst, src, year FROM e),
y AS (SELECT DISTINCT year FROM w), g AS (SELECT * FROM (SELECT DISTINCT node FROM w), y)
SELECT g.node, g.year, count(DISTINCT w.other) FILTER (w.year <= g.year) AS degree, count(DISTINCT w.other) FILTER (w.year <= g.year AND w.year > g.year - 3) AS recent_degree, count(DISTINCT w.other) FILTER (w.year = g.year) AS year_degree, g.year - max(w.year) FILTER (w.year <= g.year) AS gap FROM g JOIN w ON g.node = w.node GROUP BY 1, 2""")
def snapshot_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst"), F.year("l_shipdate").alias("year"))
    return G.snapshot_features(rows)


@query("neighbour_link_prediction", f"""WITH {SHIPPED_SQL}, d AS (SELECT src AS node, count(*) AS degree FROM ways GROUP BY src),
f AS (SELECT x.src AS u, y.dst AS v, count(*) AS common, sum(1 / ln(CAST(d.degree AS DOUBLE))) AS aa FROM ways x JOIN ways y ON x.dst = y.src JOIN d ON d.node = x.dst JOIN sources s ON s.src = x.src WHERE x.src <> y.dst GROUP BY 1, 2),
r AS (SELECT u, v, common, round(aa, 6) AS adamic_adar, round(common / (du.degree + dv.degree - common), 6) AS jaccard, du.degree * dv.degree AS preferential, round(0.8 * common + 0.2 * (SELECT count(*) FROM d) / 2, 6) AS centrality FROM f JOIN d du ON du.node = u JOIN d dv ON dv.node = v WHERE NOT EXISTS (SELECT 1 FROM ways b WHERE b.src = u AND b.dst = v))
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY u ORDER BY adamic_adar DESC, v) <= 20""")
def neighbour_link_prediction(spark, sf_dir):
    """Query nodes are the parts whose key is divisible by 20, against all nodes; the best twenty of each."""
    edges = _shipped(spark, sf_dir)
    out = L.neighbour_scores(edges, _sources(edges)).withColumns({c: F.round(c, 6) for c in ("adamic_adar", "jaccard", "centrality")})
    return L.best_of_each(out, "adamic_adar", 20)


@query("greedy_modularity")
def greedy_modularity(spark, sf_dir):
    return C.greedy_modularity(_basket(spark, sf_dir))


FREQUENT_SQL = BASKET_SQL + ", f AS MATERIALIZED (SELECT src, dst FROM basket WHERE weight >= 2), fw AS MATERIALIZED (SELECT src, dst FROM f UNION ALL SELECT dst, src FROM f), k2 AS (SELECT [src, dst] AS c FROM f)" + "".join(f", k{n + 1} AS (SELECT list_append(c, w1.dst) AS c FROM k{n} JOIN fw w1 ON w1.src = c[1] WHERE w1.dst > c[{n}] AND (SELECT count(*) FROM fw w2 WHERE w2.dst = w1.dst AND list_contains(c, w2.src)) = {n})" for n in (2, 3, 4))


@query("maximal_cliques", f"WITH {FREQUENT_SQL}, every AS (SELECT c FROM k2 UNION ALL SELECT c FROM k3 UNION ALL SELECT c FROM k4 UNION ALL SELECT c FROM k5) SELECT len(c) AS size, array_to_string(c, ',') AS members FROM every e WHERE NOT EXISTS (SELECT 1 FROM fw WHERE list_contains(e.c, fw.src) GROUP BY fw.dst HAVING count(*) = len(e.c))")
def maximal_cliques(spark, sf_dir):
    """Of the parts bought together twice or more, pairs that no third part joins included."""
    return C.cliques(_basket(spark, sf_dir).where("weight >= 2"), least=2)


@query("spectral_scores")
def spectral_scores(spark, sf_dir):
    return C.spectral_scores(_basket(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("closeness", f"WITH {SHIPPED_SQL}, {_level_sql()}, a AS ({' UNION ALL '.join(f'SELECT source, {k} AS d FROM l{k}' for k in range(LEVELS + 1))}) SELECT source AS node, round(CASE WHEN sum(d) > 0 THEN (count(*) - 1.0) * (count(*) - 1) / (((SELECT count(DISTINCT src) FROM ways) - 1.0) * sum(d)) ELSE 0 END, 6) AS closeness FROM a GROUP BY 1")
def closeness(spark, sf_dir):
    """Of the stated parts among all nodes."""
    edges = _shipped(spark, sf_dir)
    return G.closeness(edges, _sources(edges)).withColumn("closeness", F.round("closeness", 6))


@query("cross_community_bridges", f"""WITH {BASKET_SQL}, aa AS (SELECT x.src AS u, y.dst AS v, sum(1 / ln(CAST(d.degree AS DOUBLE))) AS aa FROM both_ways x JOIN both_ways y ON x.dst = y.src JOIN deg d ON d.node = x.dst WHERE x.src % 20 = 0 AND x.src <> y.dst GROUP BY 1, 2),
r AS (SELECT u, v, round(aa, 6) AS score FROM aa WHERE NOT EXISTS (SELECT 1 FROM both_ways b WHERE b.src = u AND b.dst = v) ORDER BY score DESC, u, v LIMIT 200)
SELECT u, v, score, pu.p_brand AS cu, pv.p_brand AS cv FROM r JOIN part pu ON pu.p_partkey = u JOIN part pv ON pv.p_partkey = v WHERE pu.p_brand <> pv.p_brand ORDER BY score DESC, u, v LIMIT 20""")
def cross_community_bridges(spark, sf_dir):
    """Of the 200 best Adamic-Adar pairs of the query parts with parts not bought with them, the first twenty between brands."""
    edges = _basket(spark, sf_dir)
    scores = L.neighbour_scores(edges, _sources(edges)).select("u", "v", F.round("adamic_adar", 6).alias("score"))
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    return C.bridges_between(scores, own)


@query("topology_importance")
def topology_importance(spark, sf_dir):
    """All shipments as edges from supplier to part, by every term of the importance; betweenness from the stated parts, nations of suppliers and brands of parts as communities."""
    lines = table(spark, sf_dir, "lineitem")
    lines = lines.select((-F.col("l_suppkey") - 1).alias("src"), F.col("l_partkey").alias("dst"), "l_orderkey", "l_shipdate").repartition("src", "dst")
    orders = lines.groupBy("src", "dst", "l_orderkey").agg(F.count(F.lit(1)).alias("n")).groupBy("src", "dst").agg(F.sum("n").alias("total_count"), F.count("l_orderkey").alias("papers_count"))
    days = lines.groupBy("src", "dst", F.year("l_shipdate").alias("year"), "l_shipdate").agg(F.lit(1)).groupBy("src", "dst", "year").agg(F.count("l_shipdate").alias("n"))
    days = days.groupBy("src", "dst").agg(F.sum("n").alias("evidence_count"), F.count("year").alias("active_years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    edges = orders.join(days, ["src", "dst"])
    places = table(spark, sf_dir, "supplier").select((-F.col("s_suppkey") - 1).alias("node"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("community"))
    makers = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))
    stated = table(spark, sf_dir, "lineitem").where("l_partkey % 20 = 0").select(F.col("l_partkey").alias("node")).distinct()
    return G.importance(edges, stated, places.union(makers)).select("src", "dst", F.bround("importance", 4).alias("importance"))
