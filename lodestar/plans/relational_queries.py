"""Relational breadth: grouping sets, windows, set operations and reporting queries over the star tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestar.plans.registry import query, table


def _money(column, name):
    return F.round(F.sum(column), 2).alias(name)


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


@query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(_money("l_quantity", "sum_qty"), _money("l_extendedprice", "sum_base"), _money(_revenue(), "sum_disc"), _money(_revenue() * (1 + F.col("l_tax")), "sum_charge"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query("shipping_priority", """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1995-03-15' AND l_shipdate > TIMESTAMP '1995-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10""")
def shipping_priority(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    o = table(spark, sf_dir, "orders").where("o_orderdate < timestamp_ntz '1995-03-15 00:00:00'").join(c, "o_custkey").select("o_orderkey", "o_orderdate")
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate > timestamp_ntz '1995-03-15 00:00:00'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("l_orderkey", "o_orderdate").agg(_money(_revenue(), "revenue")).orderBy(F.desc("revenue"), "l_orderkey").limit(10)


@query("supplier_volume_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""")
def supplier_volume_by_nation(spark, sf_dir):
    per = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.sum(_revenue()).alias("r"), F.count(F.lit(1)).alias("k"))
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return per.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("n_name").agg(_money("r", "revenue"), F.sum("k").alias("n"))


@query("discount_forecast", "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1994-01-01' AND l_shipdate < TIMESTAMP '1995-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
def discount_forecast(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz '1994-01-01 00:00:00' AND l_shipdate < timestamp_ntz '1995-01-01 00:00:00' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24")
    return rows.agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_discount")), 2).alias("revenue"))


@query("rollup_revenue", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_revenue(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), _money("l_quantity", "qty"))


@query("cube_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("grouping_sets", "SELECT event_type, user_id, count(*) AS n, GROUPING(event_type) AS g FROM events GROUP BY GROUPING SETS ((event_type), (user_id))")
def grouping_sets(spark, sf_dir):
    table(spark, sf_dir, "events").createOrReplaceTempView("__events")
    return spark.sql("SELECT event_type, user_id, count(*) AS n, CAST(grouping(event_type) AS INT) AS g FROM __events GROUP BY GROUPING SETS ((event_type), (user_id))")


@query("pivot_status", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1")
def pivot_status(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).count().na.fill(0)
    return rows.select("o_orderpriority", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("window_frames", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk, lag(o_orderkey) OVER w AS before, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3 FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def window_frames(spark, sf_dir):
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(W.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("rk"), F.lag("o_orderkey").over(w).alias("before"), F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"))


@query("top_orders_per_customer", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 3")
def top_orders_per_customer(spark, sf_dir):
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", r.alias("r")).where("r <= 3").drop("r")


@query("set_operations", "SELECT k, 'both' AS side FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000) UNION ALL SELECT k, 'customers' FROM (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).union(c.subtract(s).withColumn("side", F.lit("customers")))


@query("semi_and_anti", "SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AS big FROM customer")
def semi_and_anti(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey")
    big = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(big, "c_custkey", "left_semi").withColumn("big", F.lit(True)).union(c.join(big, "c_custkey", "left_anti").withColumn("big", F.lit(False)))


@query("orders_asof_events", """SELECT event_id, (SELECT max(e2.event_id) FROM events e2 WHERE e2.user_id = e.user_id AND e2.event_type = 'purchase' AND (e2.ts < e.ts OR (e2.ts = e.ts AND e2.event_id < e.event_id)) AND e2.ts = (SELECT max(e3.ts) FROM events e3 WHERE e3.user_id = e.user_id AND e3.event_type = 'purchase' AND (e3.ts < e.ts OR (e3.ts = e.ts AND e3.event_id < e.event_id)))) AS last_purchase FROM events e""")
def orders_asof_events(spark, sf_dir):
    """As-of join of each event with the user's latest purchase before it, by one ordered pass per user."""
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, -1)
    bought = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return table(spark, sf_dir, "events").select("event_id", F.last(bought, ignorenulls=True).over(w).alias("last_purchase"))


@query("sessions", """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY 1, 2""")
def sessions(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.col("ts") - F.lag("ts").over(w) <= F.expr("INTERVAL '30' MINUTE")
    rows = table(spark, sf_dir, "events").withColumn("new", F.when(gap, 0).otherwise(1))
    rows = rows.withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"))


@query("quantiles", "SELECT l_shipmode_group AS flag, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90 FROM (SELECT l_returnflag AS l_shipmode_group, l_extendedprice FROM lineitem) GROUP BY 1")
def quantiles(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.percentile("l_extendedprice", 0.5).alias("p50"), F.percentile("l_extendedprice", 0.9).alias("p90"))


@query("hourly_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def hourly_windows(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")
