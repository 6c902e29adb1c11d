"""Scratch tables in the folder that driver and executors share, for what is written once and read many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; set here only where a session on a local master has none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = "file://" + tempfile.mkdtemp(prefix="tiltwise-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """A table that is written once; it goes with ``drop``, or when the driver's JVM ends."""

    def __init__(self, df: DataFrame, partition_by: str | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/tiltwise-tables/{uuid.uuid4().hex}"
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(self.path)
        self.table = self.spark.read.schema(df.schema).parquet(self.path)
        self._files()[1].deleteOnExit(self._files()[0])

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self) -> None:
        path, system = self._files()
        system.delete(path, True)
