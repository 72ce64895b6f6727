"""Monitoring sessions: grouping photos by gaps, and what is reported of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings, times
from ..schemas import SESSION_GAP_MINUTES


def group_by_gap(images: DataFrame, key: str = "base_directory", maximum_gap_minutes: int = SESSION_GAP_MINUTES, wrap_days: bool = False, last_of_day: bool = False) -> DataFrame:
    """Add session_ordinal (from 1 within `key`) and session_day (of the session's first photo).

    A gap of `maximum_gap_minutes` or more begins a session. With `wrap_days` whole days of a gap don't count.
    With `last_of_day` only the last of the sessions that begin on one day is left. One shuffle, by `key`.
    """
    order = Window.partitionBy(key).orderBy("timestamp", "id")
    gap = times.gap_minutes(F.lag("timestamp").over(order), F.col("timestamp"), wrap_days)
    rows = images.filter(F.col("timestamp").isNotNull()).withColumn("__new", F.when(gap.isNull() | (gap >= maximum_gap_minutes), 1).otherwise(0))
    rows = rows.withColumn("session_ordinal", F.sum("__new").over(order).cast("int")).drop("__new")
    rows = rows.withColumn("session_day", F.to_date(F.min("timestamp").over(Window.partitionBy(key, "session_ordinal"))))
    if last_of_day:
        last = F.max("session_ordinal").over(Window.partitionBy(key, "session_day"))
        rows = rows.withColumn("__last", last).filter("session_ordinal = __last").drop("__last")
    return rows


def session_aggregates(sessions: DataFrame, images: DataFrame, detections: DataFrame) -> DataFrame:
    """Sessions with num_images, num_detected_objects, start_time and end_time. Both tables are counted before
    they are joined, so neither multiplies the other."""
    per_image = images.groupBy("monitoring_session_id").agg(F.count("*").alias("num_images"), F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"))
    per_object = detections.groupBy("monitoring_session_id").agg(F.count("*").alias("num_detected_objects"))
    out = sessions.join(per_image, sessions["id"] == per_image["monitoring_session_id"], "left").drop("monitoring_session_id")
    out = out.join(per_object, out["id"] == per_object["monitoring_session_id"], "left").drop("monitoring_session_id")
    return out.fillna(0, ["num_images", "num_detected_objects"])


def update_aggregates(aggregates: DataFrame, image_changes: DataFrame, detection_changes: DataFrame, images: DataFrame) -> DataFrame:
    """`aggregates` (as of `session_aggregates`) after changes of the tables.

    Changes are rows (monitoring_session_id, change, and timestamp for photos), change 1 for an inserted and -1 for a
    deleted row. Counts are added up; new times widen a session. Only where a deleted photo held the first or last
    time are the photos of that session read again: `images` is the table after the changes. Sessions that
    `aggregates` lacks are left out.
    """
    key, put, gone = "monitoring_session_id", F.col("change") > 0, F.col("change") < 0
    time = lambda f, which: f(F.when(which, F.col("timestamp")))
    photos = image_changes.groupBy(F.col(key).alias("id")).agg(F.sum("change").alias("__images"), time(F.min, put).alias("__first"), time(F.max, put).alias("__last"), time(F.min, gone).alias("__gone_first"), time(F.max, gone).alias("__gone_last"))
    objects = detection_changes.groupBy(F.col(key).alias("id")).agg(F.sum("change").alias("__objects"))
    rows = aggregates.join(photos, "id", "left").join(objects, "id", "left")
    held = F.coalesce((F.col("__gone_first") <= F.col("start_time")) | (F.col("__gone_last") >= F.col("end_time")), F.lit(False))
    again = images.join(rows.filter(held).select(F.col("id").alias(key)), key, "left_semi").groupBy(F.col(key).alias("id")).agg(F.min("timestamp").alias("__start"), F.max("timestamp").alias("__end"))
    rows = rows.withColumn("__held", held).join(again, "id", "left")
    new = {
        "num_images": F.col("num_images") + F.coalesce("__images", F.lit(0)),
        "num_detected_objects": F.col("num_detected_objects") + F.coalesce("__objects", F.lit(0)),
        "start_time": F.when(F.col("__held"), F.col("__start")).otherwise(F.least("start_time", "__first")),
        "end_time": F.when(F.col("__held"), F.col("__end")).otherwise(F.greatest("end_time", "__last")),
    }
    return rows.withColumns({c: v.cast(aggregates.schema[c].dataType) for c, v in new.items()}).select(*aggregates.columns)


def session_report(aggregates: DataFrame) -> DataFrame:
    start, end = F.col("start_time"), F.col("end_time")
    return aggregates.select("id", F.col("base_directory").alias("deployment"), F.col("day").cast("string").alias("date"), F.date_format(start, "yyyy-MM-dd HH:mm:ss").alias("start_time"), F.date_format(end, "yyyy-MM-dd HH:mm:ss").alias("end_time"), times.duration_minutes(start, end).alias("duration_minutes"), times.duration_label(start, end).alias("duration_label"), "num_images", "num_detected_objects")


def deployments(aggregates: DataFrame) -> DataFrame:
    """One row for each directory: name, sessions, images, objects."""
    rows = aggregates.groupBy("base_directory").agg(F.count("*").alias("num_sessions"), F.sum("num_images").alias("num_images"), F.sum("num_detected_objects").alias("num_objects"))
    return rows.select(strings.last_path_part(F.col("base_directory")).alias("name"), "base_directory", "num_sessions", "num_images", "num_objects")


def session_distincts(detections: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per session: distinct species that score `threshold` or more, and distinct tracks."""
    species = F.when(F.col("specific_label_score") >= threshold, F.col("specific_label"))
    return detections.groupBy("monitoring_session_id").agg(F.count_distinct(species).alias("num_species"), F.count_distinct("sequence_id").alias("num_occurrences"))


def cover_photo(images: DataFrame) -> DataFrame:
    """The largest photo of each session, the least id among equals."""
    best = F.max_by(F.struct("id", "path", "filesize"), F.struct("filesize", -F.col("id")))
    return images.groupBy("monitoring_session_id").agg(best.alias("p")).select("monitoring_session_id", F.col("p.id").alias("image_id"), F.col("p.path").alias("path"), F.col("p.filesize").alias("filesize"))


def mid_session_sample(images: DataFrame, n: int = 5) -> DataFrame:
    """`n` photos of each session from its middle on."""
    part = Window.partitionBy("monitoring_session_id")
    rows = images.withColumns({"place": F.row_number().over(part.orderBy("timestamp", "id")) - 1, "__n": F.count("*").over(part)})
    first = F.floor(F.col("__n") / 2)
    return rows.filter((F.col("place") >= first) & (F.col("place") < first + n)).drop("__n")


def neighbours(images: DataFrame, key: str = "monitoring_session_id") -> DataFrame:
    """previous_image and next_image: the last photo of an earlier, the first of a later time in the session.

    Photos of one time are no neighbours of each other, so the frames end a microsecond off.
    """
    at = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("timestamp"))
    rows = images.withColumn("__at", at).withColumn("__back", -F.col("__at"))
    # Both frames begin at an end and grow: one that shrinks would be summed anew for each row.
    before = lambda order: Window.partitionBy(key).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    earlier = F.max_by("id", F.struct("__at", "id")).over(before("__at"))
    later = F.min_by("id", F.struct("__at", "id")).over(before("__back"))
    return rows.withColumns({"previous_image": earlier, "next_image": later}).drop("__at", "__back")


def previous_in_batch(images: DataFrame, batch: str) -> DataFrame:
    """Add previous_image: the photo before in its batch, by time (the rule of batches that know no sessions)."""
    return images.withColumn("previous_image", F.lag("id").over(Window.partitionBy(batch).orderBy("timestamp", "id")))


def in_order(sessions: DataFrame, base_directory: str | None = None, by: str = "start_time") -> DataFrame:
    """Sessions, of one directory if it is named, in order of start or of `day`."""
    rows = sessions if base_directory is None else sessions.filter(F.col("base_directory") == base_directory)
    return rows.orderBy(F.asc_nulls_last(by), "id")


def count_known(sessions: DataFrame, base_directory: str) -> DataFrame:
    """One row: the number of sessions of a directory."""
    return sessions.filter(F.col("base_directory") == base_directory).agg(F.count("*").alias("count"))


def captures(images: DataFrame, session_id: int, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Photos of a session in order of time, or a page of them."""
    rows = images.filter(F.col("monitoring_session_id") == session_id).orderBy("timestamp", "id").offset(offset)
    return rows if limit is None else rows.limit(limit)


def capture_items(images: DataFrame) -> DataFrame:
    """What a list of photos shows of each."""
    return images.select("id", F.col("path").alias("source_image"), "timestamp", "last_read", "last_processed", "in_queue", F.coalesce("num_detected_objects", F.lit(0)).alias("num_detections"))


def capture_details(images: DataFrame, sessions: DataFrame, items: DataFrame) -> DataFrame:
    """Photos with the day of their session and their detections, nested, in order of id. `items` are rows of
    `detections.list_items` with image_id."""
    names = [c for c in items.columns if c != "image_id"]
    nested = items.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("detections"))
    days = sessions.select(F.col("id").alias("monitoring_session_id"), F.col("day").alias("event"))
    rows = images.join(days, "monitoring_session_id", "left").join(nested, images["id"] == nested["image_id"], "left").drop("image_id")
    return rows.withColumn("detections", F.coalesce("detections", F.array()))


def cyclic_neighbours(images: DataFrame, key: str = "monitoring_session_id") -> DataFrame:
    """next_id and previous_id in order of time, around the ends."""
    order = Window.partitionBy(key).orderBy("timestamp", "id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return images.withColumns({"next_id": F.coalesce(F.lead("id").over(order), F.first("id").over(whole)), "previous_id": F.coalesce(F.lag("id").over(order), F.last("id").over(whole))})


def by_days(sessions: DataFrame, days: Column | list) -> DataFrame:
    return sessions.filter(F.col("day").isin(days) if isinstance(days, list) else F.col("day") == days)
