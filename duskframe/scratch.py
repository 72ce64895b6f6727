"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one where none is set, if Spark runs on this machine alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    root = spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    root = tempfile.mkdtemp(prefix="duskframe-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Named Parquet tables under the shared folder.

    `save` runs a plan once and returns a scan of its rows, which cuts the lineage: a lost executor costs
    a re-read, not a recomputation. `drop` frees a table that no pending plan reads any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.written = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.written:03d}"
        self.written += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
