"""Rows that share a path: which to keep, which to delete."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def groups(images: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose key is met more than once, with group_size."""
    return images.withColumn("group_size", F.count("*").over(Window.partitionBy(key))).filter("group_size > 1")


def retention(images: DataFrame, key: str = "path", nulls_first: bool = False) -> DataFrame:
    """Duplicate rows with `keep`: the oldest that has a time, then the least id. `nulls_first` is the older rule."""
    time = F.asc_nulls_first("timestamp") if nulls_first else F.asc_nulls_last("timestamp")
    place = F.row_number().over(Window.partitionBy(key).orderBy(time, "id"))
    return groups(images, key).withColumn("keep", place == 1)


def delete_duplicates(images: DataFrame, key: str = "path", dry_run: bool = True) -> DataFrame:
    """With `dry_run` the rows that would go, else the rows that stay."""
    gone = retention(images, key).filter("not keep").select("id")
    return images.join(gone, "id", "left_semi" if dry_run else "left_anti")
