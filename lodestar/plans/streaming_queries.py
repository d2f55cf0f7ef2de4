"""Streams that run until the input is used up, into tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.operators import tables
from lodestar.plans.registry import query, table
from lodestar.streaming import events as S


def _root(spark):
    return tables.root(spark)


def _run(df, spark, mode="append"):
    """The rows that a stream over all available input appends."""
    path = f"{_root(spark)}/lodestar-stream-{uuid.uuid4().hex}"
    df.writeStream.outputMode(mode).format("parquet").option("path", f"{path}/data").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/data")


def _stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    # A table is one file or a folder of part files.
    base = f"{sf_dir}/events.parquet"
    probe = spark.read.parquet(base).select("_metadata.file_path").first()
    folder = sf_dir if probe and probe.file_path.rsplit("/", 1)[-1] == "events.parquet" else base
    reader = source if folder == base else source.option("pathGlobFilter", "events.parquet")
    return reader.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


@query("streaming_dedup", "SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events")
def streaming_dedup(spark, sf_dir):
    events = _stream(spark, sf_dir)
    doubled = events.unionByName(events)
    return _run(S.once(doubled).select("event_id"), spark).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_distinct"))


@query("streaming_windows", "WITH h AS (SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2) SELECT strftime(hour, '%Y-%m-%d %H') AS hour, event_type, n FROM h WHERE hour + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def streaming_windows(spark, sf_dir):
    """Windows that the watermark has closed when the input is used up."""
    rows = _run(S.windowed_counts(_stream(spark, sf_dir)).select("start", "event_type", "n"), spark)
    return rows.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n")


def _state(spark, sf_dir, df, keys, order, mode):
    """The last state of an upsert over all available input."""
    path = f"{_root(spark)}/lodestar-state-{uuid.uuid4().hex}"
    df.writeStream.outputMode(mode).foreachBatch(S.upsert_into(f"{path}/data", keys, order)).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return S.state(spark, f"{path}/data")


@query("streaming_edges", "SELECT user_id, json_extract_string(props, '$.k') AS k, count(*) AS weight, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last FROM events GROUP BY 1, 2")
def streaming_edges(spark, sf_dir):
    """Running weight and last contact of users and keys, upserted batch by batch."""
    out = _state(spark, sf_dir, S.running_edges(_stream(spark, sf_dir)), ["user_id", "k"], "weight", "update")
    return out.select("user_id", "k", "weight", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last"))


@query("streaming_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def streaming_upsert(spark, sf_dir):
    """The last event of each user, by batches that may be repeated."""
    rows = _stream(spark, sf_dir).select("user_id", "event_id", "event_type")
    return _state(spark, sf_dir, rows, ["user_id"], "event_id", "append").select("user_id", "event_id", "event_type")
