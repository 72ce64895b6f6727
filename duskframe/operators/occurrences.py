"""Tracks of one individual ("occurrences") and species."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings, times


def track_summary(detections: DataFrame, threshold: float = -1.0) -> DataFrame:
    """Per track: detections, best score, first and last time; tracks whose best score reaches `threshold`."""
    rows = detections.groupBy("monitoring_session_id", "sequence_id").agg(F.count("*").alias("num_detections"), F.max("specific_label_score").alias("best_score"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    return rows.filter(F.col("best_score") >= threshold)


def occurrences(detections: DataFrame, threshold: float = -1.0, examples: int = 3, limit: int | None = None) -> DataFrame:
    """Track summaries with their best examples and label, latest first.

    `limit` is per session, before the sort; the group without a track may take one of its places. The
    examples are the `examples` best scored detections; the label is that of the first.
    """
    tracks = track_summary(detections, threshold)
    if limit is not None:
        place = F.row_number().over(Window.partitionBy("monitoring_session_id").orderBy(F.asc_nulls_first("sequence_id")))
        tracks = tracks.withColumn("__place", place).filter(F.col("__place") <= limit).drop("__place")
    tracks = tracks.filter("sequence_id is not null")
    best = Window.partitionBy("monitoring_session_id", "sequence_id").orderBy(F.desc_nulls_last("specific_label_score"), "id")
    top = detections.filter("sequence_id is not null").withColumn("__place", F.row_number().over(best)).filter(F.col("__place") <= examples)
    example = F.struct(F.col("__place").alias("place"), "id", "path", F.col("specific_label").alias("label"), F.col("specific_label_score").alias("score"))
    top = top.groupBy("monitoring_session_id", "sequence_id").agg(F.array_sort(F.collect_list(example)).alias("examples"))
    rows = tracks.join(top, ["monitoring_session_id", "sequence_id"])
    return rows.withColumns({"name": strings.track_display_name(F.col("sequence_id")), "label": F.get("examples", 0)["label"], "duration_us": times.microseconds_between(F.col("start_time"), F.col("end_time"))}).orderBy(F.desc("start_time"), "sequence_id")


def list_species(detections: DataFrame, threshold: float = 0.0) -> DataFrame:
    """Per specific label, the number of its detections that are in a track."""
    rows = detections.filter((F.col("specific_label_score") >= threshold) & F.col("specific_label").isNotNull())
    return rows.groupBy("specific_label").agg(F.count("sequence_id").alias("count")).orderBy("specific_label")


def track_info(detections: DataFrame) -> DataFrame:
    """Per track: start, end, minutes, frames."""
    rows = detections.filter("sequence_id is not null").groupBy("sequence_id").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.max("sequence_frame").alias("__last"))
    return rows.withColumns({"minutes": times.duration_minutes(F.col("start_time"), F.col("end_time")), "frames": F.coalesce(F.col("__last") + 1, F.lit(1))}).drop("__last")


def collect_tracks(detections: DataFrame) -> DataFrame:
    """Per session and track, its frames in order as an array of structs."""
    frame = F.struct(F.col("sequence_frame").alias("frame"), "id", F.col("image_id").alias("image"), "path", "binary_label", "specific_label", F.col("specific_label_score").alias("score"))
    return detections.filter("sequence_id is not null").groupBy("monitoring_session_id", "sequence_id").agg(F.array_sort(F.collect_list(frame)).alias("frames"))


def single_frame_tracks(detections: DataFrame) -> DataFrame:
    return detections.filter("sequence_id is not null").groupBy("sequence_id").agg(F.count("*").alias("frames")).filter("frames = 1")


def broken_tracks(frames: DataFrame, track: str = "sequence_id", frame: str = "sequence_frame") -> DataFrame:
    """Frames whose number isn't their place in the track."""
    place = F.row_number().over(Window.partitionBy(track).orderBy(frame, "id")) - 1
    return frames.filter(F.col(track).isNotNull()).withColumn("expected_frame", place).filter(F.col(frame) != F.col("expected_frame"))


def by_label(detections: DataFrame) -> DataFrame:
    """Per track and label: count, first and last time."""
    rows = detections.filter("sequence_id is not null and specific_label is not null")
    return rows.groupBy("sequence_id", "specific_label").agg(F.count("*").alias("count"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))


def frame_counter(detections: DataFrame) -> DataFrame:
    """counter: "k of n" by the numbers of a track's frames."""
    last = F.max("sequence_frame").over(Window.partitionBy("sequence_id")) + 1
    text = F.concat((F.col("sequence_frame") + 1).cast("string"), F.lit(" of "), last.cast("string"))
    return detections.filter("sequence_id is not null").withColumn("counter", text)
