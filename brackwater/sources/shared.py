"""Where the engine may write: the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; where that is unset, a local master gets a folder of its own."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brackwater-")
        sc.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written there and read again: for a result that a plan reads several times, each time other columns."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = "4m"
UNBOUNDED = "67108864b"


def bound_batches(spark: SparkSession) -> None:
    """Have Spark hand over texts by few megabytes, where the session leaves its default: of long texts the usual number of rows fills a worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == UNBOUNDED:
        spark.conf.set(name, BATCH_BYTES)


_made: dict[tuple, str] = {}


def kept(spark: SparkSession, key: tuple, make: Callable[[str], None]) -> str:
    """The path of what make() wrote for this key in this application; it is made again if the folder is gone."""
    key = (spark.sparkContext.applicationId, *key)
    if key in _made:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_made[key])
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return _made[key]
    path = shared_path(spark, str(key[-1]))
    make(path)
    _made[key] = path
    return path


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores, if it comes in fewer parts than there are cores, as a table of one small file does."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
