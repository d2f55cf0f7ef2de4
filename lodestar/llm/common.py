"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Where that is unset, a local
    folder is made and set if all runs on this machine, as in tests; a cluster
    without it is an error, for its executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Scratch paths of the innermost :func:`scratch_discarded` of each thread.
_OWN = threading.local()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{scratch_root(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    if getattr(_OWN, "paths", None) is not None:
        _OWN.paths.append(path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a scratch folder of any store that Spark writes to."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@contextmanager
def scratch_discarded(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables that this thread makes inside, also after an error; what is to stay must have been written elsewhere."""
    outer, mine = getattr(_OWN, "paths", None), []
    _OWN.paths = mine
    try:
        yield
    finally:
        _OWN.paths = outer
        for path in mine:
            discard(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.

    Cuts lineage: an executor lost later costs only its own tasks, and what
    follows does not compute ``df`` a second time.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder_of_id(column: str, modulus: int):
    """crc32 of the id written as text, modulo ``modulus`` (null ids: null)."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it a column that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
