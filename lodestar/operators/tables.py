"""Written tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables of the innermost :func:`discarded` of each thread.
_OWN = threading.local()


def root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``.

    A local one is made only where all runs on this machine, as in tests; on a
    cluster the setting must be there.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = f"{root(spark)}/lodestar-{name}-{uuid.uuid4().hex}"
    if getattr(_OWN, "paths", None) is not None:
        _OWN.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def discarded(spark: SparkSession) -> Iterator[None]:
    """Removes the tables that this thread stages inside, also after an error; a result that reads them must have been written elsewhere."""
    outer, mine = getattr(_OWN, "paths", None), []
    _OWN.paths = mine
    try:
        yield
    finally:
        _OWN.paths = outer
        for path in mine:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
