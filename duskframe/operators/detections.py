"""Queries over detected objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, strings, vectors
from ..schemas import NEGATIVE_LABEL, POSITIVE_LABEL


def best_score() -> Column:
    return F.coalesce("specific_label_score", "binary_label_score", F.lit(0.0)).cast("double")


def filtered_page(detections: DataFrame, sessions: DataFrame, threshold: float, limit: int, offset: int = 0) -> DataFrame:
    """Detections of known sessions that score `threshold` or more, by id, a page of them."""
    rows = detections.filter(best_score() >= threshold).join(sessions.select(F.col("id").alias("monitoring_session_id"), "day"), "monitoring_session_id")
    return rows.orderBy("id").offset(offset).limit(limit)


def image_counts(detections: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per photo: objects, positive ones, classified ones, distinct species."""
    positive = F.col("binary_label") == POSITIVE_LABEL
    named = F.col("specific_label").isNotNull()
    return detections.groupBy("image_id").agg(
        F.count("*").alias("num_objects"), F.count_if(positive).alias("num_positive"), F.count_if(positive & named).alias("num_classified"),
        F.count_distinct(F.when(F.col("specific_label_score") >= threshold, F.col("specific_label"))).alias("num_species"),
    )


def completely_classified(images: DataFrame, counts: DataFrame) -> DataFrame:
    """Photos with `complete`: processed, out of the queue, and every positive object classified."""
    rows = images.join(counts, images["id"] == counts["image_id"], "left")
    done = F.col("last_processed").isNotNull() & ~F.coalesce("in_queue", F.lit(False)) & (F.coalesce("num_classified", F.lit(0)) == F.coalesce("num_positive", F.lit(0)))
    return rows.select(images["id"], done.alias("complete"))


def classification_results(detections: DataFrame, threshold: float) -> DataFrame:
    label = vectors.label_or_binary(F.col("specific_label"), F.col("specific_label_score"), F.col("binary_label"), threshold)
    return detections.select("id", label.alias("label"), F.coalesce("specific_label_score", F.lit(0.0)).alias("score"), "path")


def summarize_results(results: DataFrame, examples: int = 3, seed: int = 1) -> DataFrame:
    """Per label: count, mean score, and examples drawn by a hash of their ids."""
    draw = F.xxhash64(F.lit(seed), "id")
    # Ranked in a branch of their own, so that only the first few of a label are kept before the shuffle.
    first = results.withColumn("__place", F.row_number().over(Window.partitionBy("label").orderBy(draw, "id"))).filter(F.col("__place") <= examples)
    first = first.groupBy(F.col("label").alias("__label")).agg(F.array_sort(F.collect_list("path")).alias("examples"))
    rows = results.groupBy("label").agg(F.count("*").alias("count"), F.avg("score").alias("mean_score"))
    rows = rows.join(first, F.col("label").eqNullSafe(F.col("__label")), "left").drop("__label")
    return rows.orderBy(F.desc("count"), F.asc_nulls_last("label"))


def species_counts(detections: DataFrame) -> DataFrame:
    """Per label (specific, else binary): mean score, count, the path of the least id."""
    label = F.coalesce("specific_label", "binary_label")
    return detections.groupBy(label.alias("label")).agg(F.avg("specific_label_score").alias("mean_score"), F.count("*").alias("count"), F.min_by("path", "id").alias("path"))


def species_areas(detections: DataFrame) -> DataFrame:
    label = F.coalesce("specific_label", "binary_label")
    return detections.groupBy(label.alias("label")).agg(F.count("*").alias("count"), F.max("area_pixels").alias("max_area"))


def unique_species(detections: DataFrame) -> DataFrame:
    """Per label, its best score and count."""
    label = F.coalesce("specific_label", "binary_label", "path")
    return detections.groupBy(label.alias("label")).agg(F.max(best_score()).alias("score"), F.count("*").alias("count"))


def latest_per_box(detections: DataFrame, by: str = "last_detected") -> DataFrame:
    """Of the positive detections with one box in one photo, the latest; those without a box are as of one."""
    order = Window.partitionBy("image_id", "bbox").orderBy(F.desc_nulls_last(by), F.desc("id"))
    return detections.filter(F.col("binary_label") == POSITIVE_LABEL).withColumn("__place", F.row_number().over(order)).filter("__place = 1").drop("__place")


def list_items(detections: DataFrame) -> DataFrame:
    """What a list of detections shows of each, with its image_id."""
    return detections.select("image_id", "id", F.col("path").alias("cropped_image_path"), "bbox", "area_pixels", "last_detected", F.col("specific_label").alias("label"), F.col("specific_label_score").alias("score"), "in_queue", "notes")


def report(detections: DataFrame, images: DataFrame, sessions: DataFrame) -> DataFrame:
    """The report of detections: with the deployment and day of their session and the time and path of their photo."""
    photo = images.select(F.col("id").alias("image_id"), strings.absolute_path(F.col("base_directory"), F.col("path")).alias("source_image_path"), F.col("timestamp").alias("__time"))
    session = sessions.select(F.col("id").alias("monitoring_session_id"), strings.last_path_part(F.col("base_directory")).alias("deployment"), F.col("day").cast("string").alias("session"))
    label = vectors.reported_label(F.col("specific_label"), F.col("specific_label_score"), F.col("binary_label"), F.col("binary_label_score"))
    rows = detections.drop("base_directory").join(photo, "image_id").join(session, "monitoring_session_id")
    center = F.when(F.col("bbox").isNotNull(), geometry.center(F.col("bbox")))
    return rows.select(
        "id", "deployment", "session", F.col("monitoring_session_id").alias("session_id"), F.col("sequence_id").alias("sequence"), "sequence_frame", "source_image_path", F.col("path").alias("cropped_image_path"),
        F.date_format("__time", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "bbox", center.alias("bbox_center"), "area_pixels", label["label"].alias("label"), label["score"].alias("score"), "last_detected", "notes", "in_queue",
    )


def missing_source_data(detections: DataFrame) -> DataFrame:
    """Detections that lack the time, a size or the previous photo of their photo."""
    names = ("timestamp", "source_image_width", "source_image_height", "source_image_previous_frame")
    return detections.filter(" or ".join(f"{c} is null" for c in names))


def missing_sizes(images: DataFrame) -> DataFrame:
    """Photos whose width or height isn't known."""
    return images.filter("width is null or height is null")


def best_siblings(detections: DataFrame) -> DataFrame:
    """best_id: the best scored detection of the same track; without one, the detection itself."""
    scored = F.when(F.col("specific_label_score").isNotNull(), F.struct("specific_label_score", -F.col("id")))
    # Rows without a track are each on their own, not one group.
    alone = F.when(F.col("sequence_id").isNull(), F.col("id"))
    best = F.max_by("id", scored).over(Window.partitionBy("sequence_id", alone))
    return detections.withColumn("best_id", F.when(F.col("sequence_id").isNotNull(), F.coalesce(best, F.col("id"))).otherwise(F.col("id")))


def orphans(rows: DataFrame, parents: DataFrame, key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is missing."""
    return rows.join(parents, rows[key] == parents[parent_key], "left_anti")


def detections_per_image(detections: DataFrame, images: DataFrame) -> DataFrame:
    """One row: photos, detections, and their ratio."""
    counts = images.agg(F.count("*").alias("num_images"))
    return detections.agg(F.count("*").alias("num_detections")).join(F.broadcast(counts)).withColumn("average", F.col("num_detections") / F.col("num_images"))


def missing_tracks(detections: DataFrame) -> DataFrame:
    """Positive detections without a track."""
    return detections.filter((F.col("binary_label") == POSITIVE_LABEL) & F.col("sequence_id").isNull())


def previous_frame_pairs(detections: DataFrame, others: DataFrame, previous: DataFrame) -> DataFrame:
    """(id, previous_id): each detection with those of `others` that are of the photo before its own."""
    before = previous.select(F.col("id").alias("image_id"), "previous_image").filter("previous_image is not null")
    rows = detections.select("id", "image_id").join(before, "image_id")
    return rows.join(others.select(F.col("id").alias("previous_id"), F.col("image_id").alias("previous_image")), "previous_image").select("id", "previous_id")


def split_by_first(classified: DataFrame, column: str = "labels") -> tuple[DataFrame, DataFrame]:
    """(positive, negative) by the first of each row's labels; other first labels are in neither."""
    first = F.get(F.col(column), 0)
    return classified.filter(first == POSITIVE_LABEL), classified.filter(first == NEGATIVE_LABEL)


def last_wins(rows: DataFrame, key: str, place: str) -> DataFrame:
    """One row for each key: the last by `place`, at the place of the first."""
    each = Window.partitionBy(key)
    out = rows.withColumns({"__last": F.max(place).over(each), "__first": F.min(place).over(each)})
    return out.filter(F.col(place) == F.col("__last")).withColumn(place, F.col("__first")).drop("__last", "__first")


def of_species(detections: DataFrame, label: str, session_id: int | None = None) -> DataFrame:
    rows = detections.filter(F.col("specific_label") == label)
    return rows if session_id is None else rows.filter(F.col("monitoring_session_id") == session_id)
