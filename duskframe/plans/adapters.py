"""The driver's tables as survey tables: a deterministic mapping, so that results can be checked elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry

WIDTH, HEIGHT = 1200, 800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One photo for each event: id, base_directory, path, timestamp, filesize."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat(F.lit("/traps/trap_"), F.col("user_id").cast("string")).alias("base_directory"), F.concat(F.lit("img_"), (F.col("event_id") % 500).cast("string"), F.lit(".jpg")).alias("path"), F.col("ts").alias("timestamp"), (F.col("value") * 1000).cast("int").alias("filesize"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection for each event. A user is a trap, a day of it a photo, seven days a session."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    offset = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long")
    e = e.withColumns({"image_id": F.col("user_id") * 100000 + offset, "monitoring_session_id": F.col("user_id") * 1000 + F.floor(offset / 7), "base_directory": F.concat(F.lit("/traps/trap_"), F.col("user_id").cast("string"))})
    binary = F.when(n % 17 == 0, F.lit(None)).when(F.col("event_type") == "error", "nonmoth").otherwise("moth")
    named = (n % 17 != 0) & (F.col("event_type") != "error") & (n % 10 != 0)
    x1, y1 = (n * 37) % 900, (n * 53) % 600
    box = F.array(*[v.cast("double") for v in (x1, y1, x1 + 40 + (n * 11) % 200, y1 + 40 + (n * 7) % 150)])
    sequence = F.when(n % 13 != 0, F.concat(F.col("user_id").cast("string"), F.lit("-SEQ-"), (n % 40).cast("string")))
    e = e.select(
        n.alias("id"), "image_id", "monitoring_session_id", "user_id", "base_directory", F.col("ts").alias("timestamp"), F.col("props").alias("notes"), "value",
        F.when(n % 41 != 0, box).alias("bbox"), F.concat(F.lit("crop_"), n.cast("string"), F.lit(".jpg")).alias("path"),
        binary.alias("binary_label"), F.when(n % 17 != 0, F.round(F.least(F.col("value") / 50.0, F.lit(1.0)), 6)).alias("binary_label_score"),
        F.when(named, F.concat(F.lit("species_"), (n % 25).cast("string"))).alias("specific_label"), F.when(named, F.round(F.least(F.col("value") / 100.0, F.lit(1.0)), 6)).alias("specific_label_score"),
        F.when(n % 31 != 0, n % 3 == 0).alias("in_queue"), F.when(n % 5 != 0, F.col("ts")).alias("last_processed"), F.timestamp_add("SECOND", (n * 7919 % 100000).cast("int"), F.col("ts")).alias("last_detected"), F.when(n % 7 != 0, n % 500).alias("feature_id"), sequence.alias("sequence_id"),
    )
    # Rows without a track are each on their own, not one group.
    place = Window.partitionBy("sequence_id", F.when(F.col("sequence_id").isNull(), F.col("id"))).orderBy("timestamp", "id")
    return e.withColumn("sequence_frame", F.when(F.col("sequence_id").isNotNull(), F.row_number().over(place) - 1).cast("int")).withColumn("area_pixels", geometry.area(F.col("bbox")).cast("int"))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One photo for each trap and day; its time is that of its first event."""
    d = detections(spark, sf_dir)
    rows = d.groupBy("image_id").agg(F.min("user_id").alias("user_id"), F.min("monitoring_session_id").alias("monitoring_session_id"), F.min("base_directory").alias("base_directory"), F.min("timestamp").alias("timestamp"), F.sum(F.floor("value")).cast("long").alias("filesize"), F.max("last_processed").alias("last_processed"))
    return rows.select(F.col("image_id").alias("id"), "user_id", "monitoring_session_id", "base_directory", F.concat(F.lit("img_"), F.col("image_id").cast("string"), F.lit(".jpg")).alias("path"), "timestamp", "filesize", F.when(F.col("image_id") % 4 != 0, F.col("last_processed")).alias("last_processed"), (F.col("image_id") % 3 == 0).alias("in_queue"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-negative feature vectors: feature_id, cnn_features."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("feature_id"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("cnn_features"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monitoring sessions: id, base_directory, day (of the first photo)."""
    i = images(spark, sf_dir)
    return i.groupBy(F.col("monitoring_session_id").alias("id")).agg(F.min("base_directory").alias("base_directory"), F.to_date(F.min("timestamp")).alias("day"))
