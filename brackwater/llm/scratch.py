"""Tables written between the steps of an operator, in the folder the cluster shares.

Cutting lineage this way survives the loss of executors: the files live in the
folder named by ``spark.checkpoint.dir``, never on one machine's disk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brackwater.llm.words import bound_batches
from brackwater.sources.shared import shared_path


#: Spark deletes the shuffle files of a query that has ended, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables of one operator run, under a folder of its own; if ``tidy``, the shuffles that made one go once it is written."""

    def __init__(self, spark: SparkSession, name: str, tidy: bool = False):
        self.spark, self.tidy = spark, tidy
        bound_batches(spark)
        self.root = shared_path(spark, name)
        self.count = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write and reread; the result has no lineage but its files."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true" if self.tidy else before)
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def drop(self, *saved: DataFrame) -> None:
        """Delete tables that nothing lazy reads any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in saved:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)
