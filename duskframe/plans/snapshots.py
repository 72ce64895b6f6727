"""Tables as snapshots: each change is written whole, under a new name, before the old one goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def create(spark: SparkSession, root: str, tables: dict[str, T.StructType]) -> None:
    """Empty typed tables under `root`."""
    for name, schema in tables.items():
        spark.createDataFrame([], schema).write.mode("errorifexists").parquet(f"{root}/{name}")


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}")


def swap(df: DataFrame, root: str, name: str) -> None:
    """Write `df` beside the table, then put it in its place by renames; the old one stays until that is done."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{root}/.{name}.new")
    new, fs = _fs(spark, f"{root}/.{name}.new")
    old, _ = _fs(spark, f"{root}/.{name}.old")
    place, _ = _fs(spark, f"{root}/{name}")
    fs.delete(old, True)
    if fs.exists(place) and not fs.rename(place, old):
        raise OSError(f"cannot move {name} aside")
    if not fs.rename(new, place):
        fs.rename(old, place)
        raise OSError(f"cannot put the new {name} in place")
    fs.delete(old, True)


def check(spark: SparkSession, root: str, names: list[str]) -> dict[str, int]:
    """Rows of each table."""
    return {name: read(spark, root, name).count() for name in names}


def reset(spark: SparkSession, root: str, tables: dict[str, T.StructType], backup: str) -> None:
    """Keep the tables under another name and begin with empty ones."""
    place, fs = _fs(spark, root)
    target, _ = _fs(spark, backup)
    if fs.exists(place) and not fs.rename(place, target):
        raise OSError("cannot move the tables")
    create(spark, root, tables)
