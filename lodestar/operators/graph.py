"""Graph analytics over edge tables.

Undirected graphs are tables of (src, dst, weight) with src < dst, one row per
pair.  Iterations write their state, so a plan never grows with the rounds, and
what they join with is a plain read, which adaptive execution may broadcast or
split at a hub.  Searches start from stated nodes and go level by level through
all of them together: in arrays, a task holding the links of one component or of
some small ones (``searches``), or by joins in components too large for that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lodestar.operators import searches
from lodestar.operators.tables import staged


def undirected(pairs: DataFrame) -> DataFrame:
    """(src, dst, weight) from (src, dst) rows in either direction; no self-loops, repeated pairs add up."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    return pairs.where("src <> dst").groupBy(a.alias("src"), b.alias("dst")).agg(F.count(F.lit(1)).alias("weight"))


def simple(rows: DataFrame) -> DataFrame:
    """(src, dst, weight, directed) from rows with a directed flag and a position: one edge that is not directed makes all undirected; of parallel edges the last counts."""
    flag = rows.agg(F.coalesce(F.bool_and("directed"), F.lit(False)).alias("__all"))
    own = rows.drop("directed").crossJoin(F.broadcast(flag))
    ends = [F.when(F.col("__all"), F.col(c)).otherwise(f("src", "dst")).alias(c) for c, f in (("src", F.least), ("dst", F.greatest))]
    return own.select(*ends, "weight", "pos", F.col("__all").alias("directed")).groupBy("src", "dst", "directed").agg(F.max_by("weight", "pos").alias("weight")).select("src", "dst", "weight", "directed")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strength)."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """degree / (n - 1)."""
    own = degrees(edges)
    n = own.agg(F.count(F.lit(1)).alias("n"))
    return own.crossJoin(F.broadcast(n)).select("node", "degree", (F.col("degree") / F.greatest(F.col("n") - 1, F.lit(1))).alias("centrality"))


def directed_centrality(edges: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree, in_centrality, out_centrality) of directed edges without repeats; self-loops do not count."""
    ends = edges.where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    own = ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))
    n = own.agg(F.greatest(F.count(F.lit(1)) - 1, F.lit(1)).alias("n"))
    return own.crossJoin(F.broadcast(n)).select("node", "in_degree", "out_degree", (F.col("in_degree") / F.col("n")).alias("in_centrality"), (F.col("out_degree") / F.col("n")).alias("out_centrality"))


def summary(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density, mean degree."""
    row = degrees(edges).agg(F.count(F.lit(1)).alias("n_nodes"), (F.sum("degree") / 2).cast("long").alias("n_edges"))
    return row.select("n_nodes", "n_edges", (2 * F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).alias("density"), (2 * F.col("n_edges") / F.col("n_nodes")).alias("mean_degree"))


def structure(rows: DataFrame) -> DataFrame:
    """One row over (src, dst) rows in either direction: nodes, edges, self-loops, components, the largest of them, mean clustering.

    A node that only has a self-loop is a component of its own, without clustering.
    """
    edges = staged(undirected(rows), "structure")
    loops = rows.where("src = dst").agg(F.countDistinct("src").alias("self_loops"))
    alone = rows.where("src = dst").select(F.col("src").alias("node")).distinct().join(degrees(edges).select("node"), "node", "left_anti").agg(F.count(F.lit(1)).alias("alone"))
    sizes = components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_components"), F.max("n").alias("largest"), F.sum("n").alias("n_nodes"))
    mean = triangles(edges).agg(F.sum("clustering").alias("clustering"))
    row = sizes.crossJoin(loops).crossJoin(alone).crossJoin(mean).crossJoin(edges.agg(F.count(F.lit(1)).alias("n_edges")))
    n = F.coalesce("n_nodes", F.lit(0)) + F.col("alone")
    largest = F.greatest(F.coalesce("largest", F.lit(0)), F.least("alone", F.lit(1)))
    return row.select(n.alias("n_nodes"), "n_edges", "self_loops", (F.col("n_components") + F.col("alone")).alias("n_components"), largest.alias("largest_component"), (F.coalesce("clustering", F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("average_clustering"))


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85, weighted: bool = True, directed: bool = False, tolerance: float = 1e-6) -> DataFrame:
    """(node, rank): power iteration from the uniform start.

    It ends after ``rounds``, or when the ranks change by less than
    ``tolerance`` per node in all (0: never).  Nodes without outgoing edges give
    their rank to all nodes alike.  An undirected edge counts both ways.
    """
    own = staged(edges.select("src", "dst", F.col("weight").cast("double") if weighted else F.lit(1.0).alias("weight")), "pagerank-edges")
    ways = own if directed else own.select("src", "dst", "weight").union(own.select("dst", "src", "weight"))
    out = ways.groupBy(F.col("src").alias("s")).agg(F.sum("weight").alias("total"))
    links = staged(ways.join(out, ways.src == out.s).select("src", "dst", (F.col("weight") / F.col("total")).alias("share")), "pagerank-links")
    nodes = own.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = staged(nodes.join(out.select(F.col("s").alias("node"), F.lit(False).alias("dangling")), "node", "left").na.fill(True, ["dangling"]), "pagerank-nodes")
    n, open_ends = nodes.agg(F.count(F.lit(1)), F.count_if("dangling")).first()
    ranks = nodes.select("node", F.lit(1.0 / max(n, 1)).alias("rank"))
    for _ in range(rounds):
        given = links.join(ranks, links.src == ranks.node).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = nodes.select("node").join(given, "node", "left")
        spare = F.lit(0.0)
        if open_ends:
            lost = nodes.where("dangling").join(ranks, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
            new, spare = new.crossJoin(F.broadcast(lost)), F.col("lost") / n
        before, ranks = ranks, staged(new.select("node", (F.lit((1 - damping) / max(n, 1)) + damping * (F.coalesce("got", F.lit(0.0)) + spare)).alias("rank")), "pagerank")
        if tolerance:
            change = ranks.join(before.select("node", F.col("rank").alias("old")), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
            if (change or 0.0) < n * tolerance:
                break
    return ranks


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component, by minimum labels with shortcuts."""
    both = staged(both_ways(edges).select("src", "dst"), "component-links")
    labels = staged(both.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")), "components")
    while True:
        around = both.join(labels, both.dst == labels.node).groupBy("src").agg(F.min("component").alias("near"))
        closer = labels.join(around, labels.node == around.src, "left").select("node", F.least("component", F.coalesce("near", "component")).alias("component"), F.col("component").alias("before"))
        closer = staged(closer, "components")
        far = closer.select(F.col("node").alias("n"), F.col("component").alias("beyond"))
        jumped = closer.join(far, closer.component == far.n, "left").select("node", F.least("component", F.coalesce("beyond", "component")).alias("component"), "before")
        jumped = staged(jumped, "components")
        labels = jumped.select("node", "component")
        if jumped.where("component <> before").isEmpty():
            return labels


def triangles(edges: DataFrame) -> DataFrame:
    """(node, triangles, degree, clustering): every triangle is found once, from its node of lowest degree.

    Edges point from lower to higher degree, so a hub has few outgoing edges
    and its pairs of neighbours are not enumerated.
    """
    edges = staged(edges.select("src", "dst", "weight"), "triangle-edges")
    deg = staged(degrees(edges).select("node", "degree"), "triangle-degrees")
    a = edges.join(deg.select(F.col("node").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("node").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = F.struct("ds", "src") < F.struct("dd", "dst")
    directed = staged(a.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("v")), "oriented")
    first, second = directed.select("u", F.col("v").alias("a")), directed.select("u", F.col("v").alias("b"))
    wedges = first.join(second, "u").where("a < b")
    closing = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    found = wedges.join(closing, ["a", "b"]).select(F.explode(F.array("u", "a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("triangles"))
    out = deg.join(found, "node", "left").na.fill(0, ["triangles"])
    possible = F.col("degree") * (F.col("degree") - 1)
    return out.withColumn("clustering", F.when(possible > 0, 2 * F.col("triangles") / possible).otherwise(0.0))


def core_numbers(edges: DataFrame) -> DataFrame:
    """(node, core): each node's number starts as its degree and sinks to the h-index of its neighbours' numbers until none changes."""
    both = staged(both_ways(edges).select("src", "dst"), "core-links")
    now = staged(both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("core")), "core")
    while True:
        own, near = now.select(F.col("node").alias("src"), "core"), now.select(F.col("node").alias("dst"), F.col("core").alias("near"))
        seen = both.join(near, "dst").groupBy("src", "near").agg(F.count(F.lit(1)).alias("n")).join(own, "src").groupBy("src", "core", F.least("near", "core").alias("value")).agg(F.sum("n").alias("n"))
        reach = F.sum("n").over(W.partitionBy("src").orderBy(F.desc("value")).rowsBetween(W.unboundedPreceding, 0))
        new = seen.select("src", "core", F.least("value", reach).alias("h")).groupBy(F.col("src").alias("node")).agg(F.max("h").alias("core"), F.first("core").alias("before"))
        new = staged(new, "core")
        now = new.select("node", "core")
        if new.where("core <> before").isEmpty():
            return now


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each round a node takes the label of most weight around it; ties go to the smallest label."""
    both = staged(both_ways(edges), "label-links")
    labels = staged(both.select(F.col("src").alias("node")).distinct().withColumn("community", F.col("node")), "labels")
    for _ in range(rounds):
        votes = both.join(labels, both.dst == labels.node).groupBy("src", "community").agg(F.sum("weight").alias("votes"))
        best = votes.groupBy("src").agg(F.max_by("community", F.struct("votes", -F.col("community"))).alias("community"))
        labels = staged(best.select(F.col("src").alias("node"), "community"), "labels")
    return labels


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the weighted modularity of the communities."""
    total = edges.agg(F.sum("weight").alias("m"))
    own = labels.select(F.col("node"), F.col("community"))
    inside = edges.join(own.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(own.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst").where("cs = cd").groupBy(F.col("cs").alias("community")).agg(F.sum("weight").alias("inside"))
    strength = degrees(edges).join(own, "node").groupBy("community").agg(F.sum("strength").alias("strength"))
    parts = strength.join(inside, "community", "left").na.fill(0, ["inside"]).crossJoin(F.broadcast(total))
    return parts.agg(F.sum(F.col("inside") / F.col("m") - F.pow(F.col("strength") / (2 * F.col("m")), 2)).alias("modularity"))


def levels(edges: DataFrame, sources: DataFrame, hops: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Links both ways, and per distance from 0 the table (source, node, paths) of nodes that far from each stated source, with the number of shortest paths.

    All sources search together: a level is one join with the links and one
    anti-join with what was seen.
    """
    both = staged(both_ways(edges).select("src", "dst"), "links")
    nodes = both.select(F.col("src").alias("node")).distinct()
    found = [staged(sources.select("node").distinct().join(nodes, "node", "left_semi").select(F.col("node").alias("source"), "node", F.lit(1.0).alias("paths")), "level")]
    while hops is None or len(found) <= hops:
        seen = reduce(DataFrame.union, (level.select("source", "node") for level in found[-2:]))  # a neighbour is as far as the front, or one step less or more
        step = found[-1].join(both, F.col("node") == F.col("src")).groupBy("source", F.col("dst").alias("node")).agg(F.sum("paths").alias("paths"))
        new = staged(step.join(seen, ["source", "node"], "left_anti"), "level")
        if new.isEmpty():
            break
        found.append(new)
    return both, found


def distances(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node, distance): shortest paths of at most ``hops`` edges from the stated sources."""

    def joined(links: DataFrame, starts: DataFrame) -> DataFrame:
        _, found = levels(links, starts, hops)
        return reduce(DataFrame.union, (level.select("source", "node", F.lit(k).cast("long").alias("distance")) for k, level in enumerate(found)))

    kind = dict(edges.dtypes)["src"]
    return _searched(staged(edges.select("src", "dst", "weight"), "search-edges"), sources, searches.distances(hops), f"source {kind}, node {kind}, distance long", joined)[0]


def _searched(edges: DataFrame, sources: DataFrame | None, search, schema: str, joined) -> tuple[DataFrame, DataFrame]:
    """What ``search`` finds in components that a task may hold, and ``joined`` in the others, with null ends or weights ``joined`` in all; and the nodes.

    ``edges`` are written; without ``sources`` the search is from all nodes.  The nodes are those of the components, if these are known: few rows to read, where the ends of all links are many to deal.
    """
    if searches.odd(edges):
        nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        return joined(edges, nodes if sources is None else sources), nodes
    parts = searches.keyed(edges)
    sources = parts[1].select("node") if sources is None else sources
    found, rest = searches.searched(edges, sources, search, schema, parts)
    return found if rest is None else found.union(joined(rest, sources)), parts[1].select("node")


def weighted_distances(edges: DataFrame, sources: DataFrame, hops: int) -> DataFrame:
    """(source, node, distance): the least sum of weights over paths of at most ``hops`` edges from the stated sources."""
    own = staged(sources.select("node").distinct(), "weighted-sources")

    def joined(links: DataFrame, starts: DataFrame = own) -> DataFrame:
        both = staged(both_ways(links), "links")
        best = staged(starts.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("distance")), "reached")
        for _ in range(hops):
            step = best.join(both, best.node == both.src).select("source", F.col("dst").alias("node"), (F.col("distance") + F.col("weight")).alias("distance"))
            best = staged(best.union(step).groupBy("source", "node").agg(F.min("distance").alias("distance")), "reached")
        return best

    edges = staged(edges.select("src", "dst", "weight"), "weighted-edges")
    if searches.odd(edges):
        return joined(edges)
    kind = dict(edges.dtypes)["src"]
    parts = searches.keyed(edges)
    found, rest = searches.searched(edges, own, searches.cheapest(hops), f"source {kind}, node {kind}, distance double", parts)
    found = found.union(own.join(parts[1], "node", "left_anti").select("node", "node", F.lit(0.0)))
    if rest is None:
        return found
    return found.union(joined(rest, own.join(rest.select(F.explode(F.array("src", "dst")).alias("node")), "node", "left_semi")))


def paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, hops: int, most: int = 20) -> DataFrame:
    """(source, target, place, hops, path): of each stated pair of ends, the first ``most`` directed paths of 1 to ``hops`` edges that use no edge twice, short ones first."""
    links = staged(edges.select("src", "dst"), "path-links")
    ends = targets.select(F.col("node").alias("target")).distinct()
    walk = links.join(sources.select(F.col("node").alias("src")).distinct(), "src").select(F.col("src").alias("source"), F.col("dst").alias("node"), F.array("src", "dst").alias("path"))
    found = walk.join(ends, walk.node == ends.target)
    for hop in range(2, hops + 1):
        last = F.element_at("path", -1)
        used = F.exists(F.sequence(F.lit(1), F.size("path") - 1), lambda k: (F.element_at("path", k) == last) & (F.element_at("path", k + 1) == F.col("dst")))
        step = walk.join(links if hop < hops else links.join(ends, links.dst == ends.target, "left_semi"), walk.node == links.src).where(~used)
        walk = step.select("source", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        found = found.union(walk.join(ends, walk.node == ends.target))
    length = (F.size("path") - 1).cast("long")
    place = F.row_number().over(W.partitionBy("source", "target").orderBy(length, "path"))
    return found.where("source <> target").select("source", "target", place.alias("place"), length.alias("hops"), "path").where(F.col("place") <= most)


def dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(u, v, dependency): Brandes dependencies of nodes (u = v) and edges (u < v), summed over the stated sources.

    The levels of all sources are walked back together: what a node hands to a
    neighbour one step nearer is its share of the shortest paths.
    """
    return _dependencies(staged(edges.select("src", "dst", "weight"), "search-edges"), sources)[0]


def _dependencies(edges: DataFrame, sources: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """As ``dependencies``, of written edges, and the nodes."""
    kind = dict(edges.dtypes)["src"]
    found, nodes = _searched(edges, sources, searches.dependencies, f"u {kind}, v {kind}, dependency double", _joined_dependencies)
    return found.groupBy("u", "v").agg(F.sum("dependency").alias("dependency")), nodes


def _joined_dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    both, found = levels(edges, sources)
    parts = []
    beyond = found[-1].withColumn("share", F.lit(0.0))
    for depth in range(len(found) - 1, 0, -1):
        nearer = found[depth - 1].select("source", F.col("node").alias("u"), F.col("paths").alias("pu"))
        handed = beyond.join(both, F.col("node") == F.col("src")).select("source", F.col("node").alias("v"), F.col("dst").alias("u"), "paths", "share").join(nearer, ["source", "u"])
        handed = staged(handed.select("source", "u", "v", (F.col("pu") / F.col("paths") * (1 + F.col("share"))).alias("part")), "handed")
        parts.append(handed.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.col("part").alias("dependency")))
        if depth > 1:
            got = handed.groupBy("source", F.col("u").alias("node")).agg(F.sum("part").alias("share"))
            beyond = staged(found[depth - 1].join(got, ["source", "node"], "left").na.fill(0.0, ["share"]), "shares")
            parts.append(beyond.select(F.col("node").alias("u"), F.col("node").alias("v"), F.col("share").alias("dependency")))
    if not parts:
        return found[0].select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("dependency")).limit(0)
    last = found[-1].select(F.col("node").alias("u"), F.col("node").alias("v"), F.lit(0.0).alias("dependency")).distinct()
    return reduce(DataFrame.union, [*parts, last])


def betweenness(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(u, v, betweenness): of nodes (u = v) and edges (u < v), normalised, from all nodes, or from stated sources and scaled to all nodes as sources."""
    edges = staged(edges.select("src", "dst", "weight"), "betweenness-edges")
    found, nodes = _dependencies(edges, sources)
    return _normalised(found, nodes, nodes if sources is None else sources)


def _normalised(found: DataFrame, nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """``found`` with betweenness in place of dependency."""
    sizes = nodes.join(sources.select("node", F.lit(1).alias("own")).distinct(), "node", "left").agg(F.count(F.lit(1)).cast("double").alias("n"), F.count("own").alias("k"))
    pairs = F.when(F.col("u") == F.col("v"), (F.col("n") - 1) * (F.col("n") - 2)).otherwise(F.col("n") * (F.col("n") - 1))
    scaled = F.when(pairs > 0, F.col("dependency") * F.col("n") / F.col("k") / pairs).otherwise(F.lit(0.0))
    return found.crossJoin(F.broadcast(sizes)).select(*(scaled.alias("betweenness") if c == "dependency" else c for c in found.columns))


def closeness(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, closeness) of the stated nodes: (r - 1)² / ((n - 1) * sum of distances) with r nodes in reach."""
    edges = staged(edges.select("src", "dst", "weight"), "closeness-edges")

    def joined(links: DataFrame, starts: DataFrame) -> DataFrame:
        _, found = levels(links, starts)
        far = reduce(DataFrame.union, (level.groupBy("source").agg(F.count(F.lit(1)).alias("near"), (F.count(F.lit(1)) * k).alias("far")) for k, level in enumerate(found)))
        return far.groupBy(F.col("source").alias("node")).agg(F.sum("near").alias("near"), F.sum("far").alias("far")).select("node", F.col("node").alias("twin"), "near", "far")

    kind = dict(edges.dtypes)["src"]
    found, nodes = _searched(edges, sources, searches.reach, f"node {kind}, twin {kind}, near long, far long", joined)
    sums = found.withColumn("others", F.col("near") - 1).crossJoin(F.broadcast(nodes.agg(F.count("node").alias("n"))))
    return sums.select("node", F.when(F.col("far") > 0, F.col("others") * F.col("others") / ((F.col("n") - 1) * F.col("far"))).otherwise(0.0).alias("closeness"))


def yearly_snapshots(rows: DataFrame) -> DataFrame:
    """(src, dst, year, weight, total): weight per year and the running total of a pair."""
    per_year = rows.groupBy("src", "dst", "year").agg(F.count(F.lit(1)).alias("weight"))
    running = F.sum("weight").over(W.partitionBy("src", "dst").orderBy("year").rowsBetween(W.unboundedPreceding, 0))
    return per_year.withColumn("total", running)


def snapshot_features(rows: DataFrame, recent: int = 3) -> DataFrame:
    """(node, year, degree, recent_degree, year_degree, gap) for every node and every year of the table.

    Distinct partners up to the year, in the last ``recent`` years and in the
    year itself, and the years since the last contact (null before the first).
    """
    ways = rows.where("src <> dst").select("src", "dst", "year").union(rows.where("src <> dst").select("dst", "src", "year")).toDF("node", "other", "year")
    per_year = staged(ways.distinct(), "contacts")
    years = per_year.select("year").distinct()
    grid = per_year.select("node").distinct().crossJoin(F.broadcast(years))  # years are calendar years: a bounded broadcast
    firsts = per_year.groupBy("node", "other").agg(F.min("year").alias("year")).groupBy("node", "year").agg(F.count(F.lit(1)).alias("new"))
    now = per_year.groupBy("node", "year").agg(F.count(F.lit(1)).alias("year_degree"))
    late = per_year.select("node", "other", F.explode(F.sequence(F.col("year"), F.col("year") + recent - 1)).alias("year")).distinct().groupBy("node", "year").agg(F.count(F.lit(1)).alias("recent_degree"))
    upto = W.partitionBy("node").orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    out = grid.join(firsts, ["node", "year"], "left").join(now, ["node", "year"], "left").join(late, ["node", "year"], "left").na.fill(0, ["new", "year_degree", "recent_degree"])
    last = F.last(F.when(F.col("year_degree") > 0, F.col("year")), ignorenulls=True).over(upto)
    return out.select("node", "year", F.sum("new").over(upto).alias("degree"), "recent_degree", "year_degree", (F.col("year") - last).alias("gap"))


def _between_and_cores(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(u, v, betweenness, core): nodes (u = v), all of them and with their core number, and edges (u < v) with a dependency.

    Both need the links of whole components, which are dealt once; ``edges`` are
    written, without nulls and self-loops.
    """
    parts = searches.keyed(edges)
    kind = dict(edges.dtypes)["src"]
    found, rest = searches.searched(edges, sources, searches.dependencies, f"u {kind}, v {kind}, dependency double", parts)
    core, _ = searches.cores(parts)
    if rest is not None:
        found, core = found.union(_joined_dependencies(rest, sources)), core.union(core_numbers(rest))
    rows = found.withColumn("core", F.lit(None).cast("long")).union(core.select("node", "node", F.lit(0.0), "core"))
    return _normalised(rows.groupBy("u", "v").agg(F.sum("dependency").alias("dependency"), F.max("core").alias("core")), parts[1].select("node"), sources)


# Weights of the terms of an edge's importance.
IMPORTANCE = {"edge_betweenness": 0.28, "pagerank": 0.18, "node_betweenness": 0.14, "core": 0.12, "flow": 0.10, "support": 0.10, "persistence": 0.05, "cross": 0.03}


def importance(edges: DataFrame, sources: DataFrame, labels: DataFrame) -> DataFrame:
    """(src, dst, the terms, importance) of directed edges.

    ``edges``: src, dst, total_count, papers_count, evidence_count and years, an
    array, or in its place active_years, first_year and last_year.  Every metric is divided by its maximum over all edges; support and
    persistence are means of three such shares, cross is 1 between communities
    of ``labels`` (node, community).  Betweenness is from the stated sources.
    """
    if "years" in edges.columns:
        edges = edges.withColumns({"active_years": F.size("years"), "first_year": F.array_min("years"), "last_year": F.array_max("years")}).drop("years")
    own = staged(edges, "importance-edges")
    weighted = own.select("src", "dst", F.lit(1).cast("long").alias("weight"))
    plain = staged(undirected(weighted), "importance-graph")
    between = staged(_between_and_cores(plain, sources), "importance-betweenness")
    nodes = pagerank(weighted, weighted=False, directed=True).join(directed_centrality(weighted), "node")
    nodes = nodes.join(between.where("u = v").select(F.col("u").alias("node"), "core", "betweenness"), "node").join(labels, "node", "left")
    nodes = staged(nodes.select("node", "rank", "core", "betweenness", "in_centrality", "out_centrality", "community"), "importance-nodes")
    rows = own.withColumns({"u": F.least("src", "dst"), "v": F.greatest("src", "dst")}).join(between.where("u < v").select("u", "v", F.col("betweenness").alias("edge_betweenness")), ["u", "v"], "left").na.fill(0.0, ["edge_betweenness"])
    for end in ("src", "dst"):
        rows = rows.join(nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in nodes.columns[1:])), end)
    active, span = F.col("active_years"), F.col("last_year") - F.col("first_year") + 1

    def mean(a: str, b: str):
        return (F.col(f"{a}_src") + F.col(f"{b}_dst")) / 2

    metrics = {
        "edge_betweenness": F.col("edge_betweenness"),
        "pagerank": mean("rank", "rank"),
        "node_betweenness": mean("betweenness", "betweenness"),
        "core": mean("core", "core"),
        "flow": mean("out_centrality", "in_centrality"),
        "total_count": F.col("total_count"),
        "papers_count": F.col("papers_count"),
        "evidence_count": F.col("evidence_count"),
        "active_years": active,
        "span": F.coalesce(span, F.lit(0)),
        "density": F.coalesce(active / span, F.lit(0.0)),
    }
    cross = F.coalesce((F.col("community_src") != F.col("community_dst")).cast("double"), F.lit(0.0))
    rows = staged(rows.select("src", "dst", *(m.cast("double").alias(k) for k, m in metrics.items()), cross.alias("cross")), "importance-metrics")
    most = rows.agg(*(F.max(k).alias(f"max_{k}") for k in metrics))

    def share(k: str):
        return F.when(F.col(f"max_{k}") > 0, F.col(k) / F.col(f"max_{k}")).otherwise(0.0)

    terms = {k: share(k) for k in ("edge_betweenness", "pagerank", "node_betweenness", "core", "flow")}
    terms["support"] = (share("total_count") + share("papers_count") + share("evidence_count")) / 3
    terms["persistence"] = (share("active_years") + share("span") + share("density")) / 3
    terms["cross"] = F.col("cross")
    out = rows.crossJoin(F.broadcast(most)).select("src", "dst", *(t.alias(k) for k, t in terms.items()))
    score = reduce(lambda a, b: a + b, (w * F.col(k) for k, w in IMPORTANCE.items()))
    return out.withColumn("importance", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))


def answer(question: str, labels: dict[str, DataFrame], edges: DataFrame, limit: int = 20) -> DataFrame:
    """The few questions that a graph store without a query language answers: a count per label, or one of three analyses of ``edges``.

    ``count <Label>``, ``pagerank``, ``degree`` and ``components``; anything else is an error.
    """
    words = question.strip().split()
    if len(words) == 2 and words[0].lower() == "count" and words[1] in labels:
        return labels[words[1]].agg(F.lit(words[1]).alias("name"), F.count(F.lit(1)).cast("double").alias("value"))
    if [w.lower() for w in words] == ["pagerank"]:
        return pagerank(edges).orderBy(F.desc("rank"), "node").limit(limit).select(F.col("node").cast("string").alias("name"), F.col("rank").alias("value"))
    if [w.lower() for w in words] == ["degree"]:
        return degree_centrality(edges).orderBy(F.desc("centrality"), "node").limit(limit).select(F.col("node").cast("string").alias("name"), F.col("centrality").alias("value"))
    if [w.lower() for w in words] == ["components"]:
        return components(edges).groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(limit).select(F.col("component").cast("string").alias("name"), F.col("n").cast("double").alias("value"))
    raise ValueError(f"unknown question: {question}")


def top_nodes(scores: DataFrame, column: str, k: int = 20) -> DataFrame:
    """(place, node, score): the k nodes of the largest value, ties to the smaller node."""
    best = scores.orderBy(F.desc(column), "node").limit(k)
    place = F.row_number().over(W.orderBy(F.desc("score"), "node"))  # over k rows
    return best.select("node", F.col(column).alias("score")).withColumn("place", place).select("place", "node", "score")
