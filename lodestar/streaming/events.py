"""Structured Streaming over event files: windowed counts, dedup within the watermark, running edges and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of event files with an event time that watermarks accept."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def running_edges(events: DataFrame) -> DataFrame:
    """Weight and last contact of each user and key, for update mode."""
    return events.groupBy("user_id", F.get_json_object("props", "$.k").alias("k")).agg(F.count(F.lit(1)).alias("weight"), F.max("ts").alias("last"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a state below ``path`` that were written to their end, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(place):
        return []
    names = [f.getPath().getName() for f in store.listStatus(place)]
    whole = [int(n[1:]) for n in names if n.startswith("v") and n[1:].isdigit() and store.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS"))]
    return sorted(whole)


def upsert_into(path: str, keys: list[str], order: str, keep: int = 2):
    """A foreachBatch function that keeps the latest row per key in versioned Parquet folders below ``path``.

    Each batch writes its version from the last whole one before it, whatever
    its number, so a batch that is repeated writes the same version again.
    Batches without rows write nothing.  The last ``keep`` versions stay.
    """
    from lodestar.operators.events import latest

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if batch.isEmpty():
            return
        columns, schema = batch.columns, batch.schema
        known = [v for v in versions(spark, path) if v < epoch]
        if known:
            batch = spark.read.schema(schema).parquet(f"{path}/v{known[-1]}").unionByName(batch)
        latest(batch, keys, order).select(columns).write.mode("overwrite").parquet(f"{path}/v{epoch}")
        for old in known[: max(0, len(known) + 1 - keep)]:
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{old}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    return run


def state(spark: SparkSession, path: str) -> DataFrame:
    """The last whole version of a state."""
    return spark.read.parquet(f"{path}/v{versions(spark, path)[-1]}")
