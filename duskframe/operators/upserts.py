"""Changes to tables, as functions from table to table; see `plans.snapshots` for writing the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry


def replace_detections(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Detections of the photos in `found` are replaced by its rows; area follows from the box, and they wait."""
    new = found.withColumn("area_pixels", geometry.area(F.col("bbox")).cast("int")).withColumn("in_queue", F.lit(True))
    kept = existing.join(found.select("image_id").distinct(), "image_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def mark_processed(images: DataFrame, ids: DataFrame, at: Column) -> DataFrame:
    rows = images.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    return rows.withColumn("last_processed", F.when(F.col("__hit"), at).otherwise(F.col("last_processed"))).drop("__hit")


def update_by_id(rows: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows with the columns of `changes` (id and others) where an id has some; a null there changes nothing."""
    names = [c for c in changes.columns if c != "id"]
    new = changes.select("id", *[F.col(c).alias(f"__{c}") for c in names])
    return rows.join(new, "id", "left").withColumns({c: F.coalesce(f"__{c}", c) for c in names}).select(*rows.columns)


def insert_missing(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """`rows` and those of `new` whose key isn't there yet (get or create)."""
    return rows.unionByName(new.join(rows.select(*key).distinct(), key, "left_anti").select(*new.columns), allowMissingColumns=True)


def add_scanned(images: DataFrame, scanned: DataFrame, key: list[str]) -> DataFrame:
    """Scanned photos of sessions (by `key`) of which more were found than are known; nothing is deleted."""
    known = images.groupBy(*key).agg(F.count("*").alias("__known"))
    counts = scanned.groupBy(*key).agg(F.count("*").alias("__found")).join(known, key, "left")
    grown = counts.filter(F.col("__found") > F.coalesce("__known", F.lit(0))).select(*key)
    return insert_missing(images, scanned.join(grown, key, "left_semi"), [*key, "path"])


def delete_of_image(detections: DataFrame, image_id: int) -> DataFrame:
    return detections.filter(F.coalesce(F.col("image_id") != image_id, F.lit(True)))


def fill_from_images(detections: DataFrame, images: DataFrame, previous: DataFrame) -> DataFrame:
    """Missing times, sizes and previous photos of detections, from their photos."""
    source = images.select(F.col("id").alias("image_id"), F.col("timestamp").alias("__time"), F.col("width").alias("__width"), F.col("height").alias("__height"))
    before = previous.select(F.col("id").alias("image_id"), F.col("previous_image").alias("__before"))
    rows = detections.join(source, "image_id", "left").join(before, "image_id", "left")
    pairs = {"timestamp": "__time", "source_image_width": "__width", "source_image_height": "__height", "source_image_previous_frame": "__before"}
    return rows.withColumns({c: F.coalesce(c, other) for c, other in pairs.items()}).select(*detections.columns)
