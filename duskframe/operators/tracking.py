"""Tracking individuals from photo to photo.

A detection's parent is the cheapest detection of the photo before its own in the session, if that costs the
threshold or less. The choice depends on boxes and features alone, so all parents come from one equi join on
(session, frame), and tracks are the trees of the parent forest, found by pointer doubling: after k rounds a
row points 2^k frames back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, strings, vectors
from ..schemas import POSITIVE_LABEL, TRACKING_COST_THRESHOLD
from ..scratch import Scratch


#: What tracking says about a detection.
TRACK_COLUMNS = ("sequence_id", "sequence_frame", "sequence_previous_id", "sequence_previous_cost")


def number_frames(images: DataFrame, key: str = "monitoring_session_id") -> DataFrame:
    """frame_no, from 0, of each photo within its session."""
    return images.withColumn("frame_no", F.row_number().over(Window.partitionBy(key).orderBy("timestamp", "id")) - 1)


def total_cost(a_features: Column, b_features: Column, a_box: Column, b_box: Column, diag: Column, weights: tuple[float, float, float, float] = (1, 1, 1, 1), strict: bool = False) -> Column:
    """(1 - cosine) + (1 - iou) + (1 - size ratio) + distance ratio, each times its weight.

    With `strict` a cosine outside 0 to 1 or a distance above the diagonal is an error.
    """
    like, far = vectors.cosine(a_features, b_features), geometry.distance_ratio(a_box, b_box, diag)
    if strict:
        like = F.when((like < 0) | (like > 1 + 1e-9), F.raise_error(F.lit("cosine out of range")).cast("double")).otherwise(like)
        far = F.when(far > 1, F.raise_error(F.lit("distance above the diagonal")).cast("double")).otherwise(far)
    cnn, over, box, dist = weights
    return cnn * (1 - like) + over * (1 - geometry.iou(a_box, b_box)) + box * (1 - geometry.size_ratio(a_box, b_box)) + dist * far


def before_gap(positives: DataFrame) -> DataFrame:
    """Detections that come before, by id, the first one without features of their photo: the literal rule ends both
    its loops at such a one, so it and all after it neither look for a parent nor are one."""
    bare = F.col("cnn_features").isNull() | (F.size("cnn_features") == 0)
    first = F.min(F.when(bare, F.col("id"))).over(Window.partitionBy("image_id"))
    return positives.withColumn("__first_bare", first).filter(F.col("__first_bare").isNull() | (F.col("id") < F.col("__first_bare"))).drop("__first_bare")


def candidates(detections: DataFrame, images: DataFrame, width: int, height: int, key: str = "monitoring_session_id", in_order: bool = False, features: DataFrame | None = None) -> DataFrame:
    """(id, previous_id, cost) of all positive detections with features, against those of the frame before.

    With `in_order` only those before the first without features of their photo count (`before_gap`).
    With `features` (feature_id, cnn_features) detections have a feature_id in place of features. Those in use are met
    by the pairs, so where many detections share them no detection is shuffled with features.
    """
    late = features is not None and not in_order
    if features is not None and in_order:
        detections = detections.join(features, "feature_id", "left")
    own = "feature_id" if late else "cnn_features"
    frames = number_frames(images, key).select(F.col("id").alias("image_id"), F.col(key).alias("session"), "frame_no")
    rows = detections.filter(F.col("binary_label") == POSITIVE_LABEL)
    rows = (before_gap(rows.select("id", "image_id", "bbox", "cnn_features")) if in_order else rows).filter(F.col(own).isNotNull() & F.col("bbox").isNotNull())
    used = None
    if late:
        known = features.filter(F.col("cnn_features").isNotNull()).join(rows.select("feature_id").distinct(), "feature_id", "left_semi")
        used = Scratch(detections.sparkSession, "features").save(known.select("feature_id", "cnn_features"))
    rows = rows.select("id", "image_id", "bbox", own).join(frames, "image_id")
    before = rows.select(F.col("session").alias("s"), (F.col("frame_no") + 1).alias("f"), F.col("id").alias("previous_id"), F.col("bbox").alias("previous_box"), F.col(own).alias(f"previous_{own}"))
    pairs = rows.join(before, (F.col("session") == F.col("s")) & (F.col("frame_no") == F.col("f")))
    diag = geometry.diagonal(F.lit(float(width)), F.lit(float(height)))
    if late:
        before = used.select(F.col("feature_id").alias("previous_feature_id"), F.col("cnn_features").alias("previous_cnn_features"))
        pairs = pairs.join(used, "feature_id").join(before, "previous_feature_id")
    return pairs.select("id", "previous_id", total_cost(F.col("cnn_features"), F.col("previous_cnn_features"), F.col("bbox"), F.col("previous_box"), diag).alias("cost"))


def parents(pairs: DataFrame, threshold: float = TRACKING_COST_THRESHOLD) -> DataFrame:
    """(id, previous_id, cost) of the cheapest candidate, the least id among equals, where it costs `threshold` or less.

    Costs count to 9 places: sums in another order must not decide between equals.
    """
    cost = F.round("cost", 9)
    best = pairs.groupBy("id").agg(F.min(F.struct(cost.alias("cost"), "previous_id")).alias("b"))
    return best.filter(F.col("b.cost") <= threshold).select("id", "b.previous_id", "b.cost")


def resolve_tracks(ids: DataFrame, links: DataFrame) -> DataFrame:
    """(id, root, frame) of every id: the first detection of its track, and the steps to it."""
    scratch = Scratch(ids.sparkSession, "tracks")
    rows = ids.join(links.select("id", "previous_id"), "id", "left")
    step = F.when(F.col("previous_id").isNull(), 0).otherwise(1)
    rows = scratch.save(rows.select("id", F.coalesce("previous_id", "id").alias("root"), step.alias("frame")))
    while True:
        up = rows.filter("root != id").select(F.col("id").alias("__id"), F.col("root").alias("__root"), F.col("frame").alias("__frame"))
        after = rows.join(up, F.col("root") == F.col("__id"), "left")
        after = after.select("id", F.coalesce("__root", "root").alias("root"), (F.col("frame") + F.coalesce("__frame", F.lit(0))).alias("frame"), F.col("__id").isNotNull().alias("moved"))
        after = scratch.save(after)
        scratch.drop(rows)
        rows = after
        if not rows.filter("moved").limit(1).count():
            return rows.select("id", "root", "frame")


def track(detections: DataFrame, images: DataFrame, sessions: DataFrame, width: int, height: int, threshold: float = TRACKING_COST_THRESHOLD, key: str = "monitoring_session_id", in_order: bool = False, features: DataFrame | None = None) -> DataFrame:
    """id, sequence_id, sequence_frame, sequence_previous_id, sequence_previous_cost of all positive detections.

    All tracks are computed anew. Detections without features are tracks of their own. `sessions` has id and day;
    `features` as in `candidates`.
    """
    links = parents(candidates(detections, images, width, height, key, in_order, features), threshold)
    links = Scratch(detections.sparkSession, "links").save(links)
    mine = detections.filter(F.col("binary_label") == POSITIVE_LABEL)
    rows = resolve_tracks(mine.select("id"), links).join(links, "id", "left")
    of = mine.select("id", "image_id").join(images.select(F.col("id").alias("image_id"), F.col(key).alias("session")), "image_id").join(sessions.select(F.col("id").alias("session"), "day"), "session")
    return rows.join(of.select("id", "day"), "id").select("id", strings.track_id(F.col("day"), F.col("root")).alias("sequence_id"), F.col("frame").alias("sequence_frame"), F.col("previous_id").alias("sequence_previous_id"), F.col("cost").alias("sequence_previous_cost"))


def stale_sessions(detections: DataFrame, positives_only: bool = True) -> DataFrame:
    """Sessions with a detection that has no track yet. Other than positive ones never get one."""
    rows = detections.filter(F.col("sequence_id").isNull())
    if positives_only:
        rows = rows.filter(F.col("binary_label") == POSITIVE_LABEL)
    return rows.select("monitoring_session_id").distinct()


def retrack(detections: DataFrame, tracks: DataFrame) -> DataFrame:
    """Detections with the track columns of the sessions in `tracks` replaced."""
    new = tracks.select("id", *[F.col(c).alias(f"__{c}") for c in TRACK_COLUMNS], F.lit(True).alias("__new"))
    rows = detections.join(new, "id", "left")
    columns = {c: F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c) if c in detections.columns else F.lit(None)) for c in TRACK_COLUMNS}
    return rows.withColumns(columns).select(*detections.columns, *[c for c in columns if c not in detections.columns])
