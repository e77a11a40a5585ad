"""Tables between the steps of a job, in the folder that all executors share: they cut the lineage, and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Rows dealt to the tasks of a shuffle: a small file is one row group and so one task, whatever its rows cost."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def large(rows: DataFrame) -> DataFrame:
    """Rows that a join must not broadcast: of a table that grows with the input, whatever the few bytes of its files make the planner think."""
    return rows.hint("merge")


class NoSharedFolder(RuntimeError):
    """``spark.checkpoint.dir`` is unset on a cluster."""


class Scratch:
    """Writes tables under ``spark.checkpoint.dir`` and reads them back; they go with the session.

    On a local master without that setting the folder is a temporary one; on a cluster its absence is an error, as executors would write to their own disks.
    """

    def __init__(self, spark: SparkSession) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.sparkContext.master.startswith("local["):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        root = root or "file://" + tempfile.mkdtemp(prefix="veilspark-")
        self.spark, self.root = spark, f"{root.rstrip('/')}/veilspark-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
