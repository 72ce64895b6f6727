"""Changes of stored tables that read and rewrite the touched buckets alone, by any number of writers at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import queues, tracking, upserts
from ..operators import sessions as grouped
from ..scratch import Scratch
from .versions import BUCKET, VersionedTable


def pull(table: VersionedTable, queue: queues.Queue, n: int) -> DataFrame | None:
    """Take the first n waiting rows by id out of a queue; no other puller gets them. None if none waits.

    The rows are chosen over the whole table, since a queue's scope may be; only their buckets are rewritten.
    """

    def work(base):
        rows = base.read()
        # Written before the flags change, so who pulls can read them whatever becomes of the table.
        taken = Scratch(table.spark, "pulled").save(queues.pull(rows, queue, n)[0])
        touched = sorted(r[0] for r in taken.select(BUCKET).distinct().collect())
        if not touched:
            return None
        return queues.set_flag(base.read(touched), taken.select("id"), False), touched, taken.drop(BUCKET)

    return table.change(work)


def replace_detections(table: VersionedTable, found: DataFrame) -> None:
    """`upserts.replace_detections` on a table whose key is image_id."""

    def work(base):
        touched = base.touched(found)
        return (upserts.replace_detections(base.read(touched).drop(BUCKET), found), touched, None) if touched else None

    table.change(work)


def update_by_id(table: VersionedTable, changes: DataFrame) -> None:
    """`upserts.update_by_id`; rows are looked for by id where that is not the key."""

    def work(base):
        touched = [b for b in base.touched(changes, None if base.key == ["id"] else ["id"]) if b in base.parts]
        return (upserts.update_by_id(base.read(touched), changes), touched, None) if touched else None

    table.change(work)


def retrack(detections: VersionedTable, images: VersionedTable, sessions: DataFrame, width: int, height: int, in_order: bool = False, **options) -> int:
    """Compute the tracks of all stale sessions anew; the number of buckets that were rewritten.

    Both tables have monitoring_session_id as their key and the same number of buckets. Of the photos and of the
    detections the buckets of stale sessions are read, and but the columns that decide on stale sessions nothing else.
    """
    key = "monitoring_session_id"

    def work(base):
        stale = Scratch(detections.spark, "stale").save(tracking.stale_sessions(base.read().select(key, "sequence_id", "binary_label")))
        touched = base.touched(stale)
        if not touched:
            return None
        photos = images.version()
        if (photos.key, photos.buckets) != ([key], base.buckets) or base.key != [key]:
            raise ValueError("both tables must be dealt by session, in as many buckets")
        rows, mine = base.read(touched), photos.read(touched).join(stale, key, "left_semi")
        tracks = tracking.track(rows.join(stale, key, "left_semi"), mine, sessions, width, height, in_order=in_order, **options)
        return tracking.retrack(rows, tracks), touched, len(touched)

    return detections.change(work) or 0


def late_photos(detections: VersionedTable, sessions: DataFrame) -> None:
    """Clear the tracks of sessions (`session`, as `streaming.tracker.late_sessions` names them), so that `retrack` computes them anew."""
    key = "monitoring_session_id"
    late = sessions.select(F.col("session").cast("long").alias(key)).distinct()

    def work(base):
        touched = base.touched(late)
        if not touched:
            return None
        rows = base.read(touched).join(late.withColumn("__late", F.lit(True)), key, "left")
        empty = {c: F.when(F.col("__late").isNull(), F.col(c)) for c in tracking.TRACK_COLUMNS if c in rows.columns}
        return rows.withColumns(empty).drop("__late"), touched, None

    detections.change(work)


def refresh_aggregates(aggregates: VersionedTable, image_changes: DataFrame, detection_changes: DataFrame, images: DataFrame) -> None:
    """`sessions.update_aggregates` on a stored table whose key is id: buckets without a changed session stay."""

    def work(base):
        changed = image_changes.select("monitoring_session_id").unionByName(detection_changes.select("monitoring_session_id"))
        touched = [b for b in base.touched(changed.select(F.col("monitoring_session_id").alias("id"))) if b in base.parts]
        if not touched:
            return None
        return grouped.update_aggregates(base.read(touched).drop(BUCKET), image_changes, detection_changes, images), touched, None

    aggregates.change(work)
