"""The five processing queues. A queue is a flag on rows; its operations give a new table, and who calls them
writes it as the next snapshot. `plans.maintenance.pull` takes rows out of a stored queue, for many pullers at once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import POSITIVE_LABEL
from .detections import previous_frame_pairs


@dataclass(frozen=True)
class Queue:
    """scope: which rows it is about; open: which of them are unprocessed; one_per_box: only the newest of a box."""

    name: str
    scope: str
    open: str
    one_per_box: bool
    pull: str = "true"
    skips_null_flags: bool = True


QUEUES = {
    "source_images": Queue("source_images", "true", "last_processed is null", False, skips_null_flags=False),
    "detected_objects": Queue("detected_objects", "bbox is not null", "binary_label is null", True),
    "unclassified_objects": Queue("unclassified_objects", f"binary_label = '{POSITIVE_LABEL}'", "specific_label is null", True, "bbox is not null"),
    "objects_without_features": Queue("objects_without_features", f"binary_label = '{POSITIVE_LABEL}'", "cnn_features is null", True),
    "untracked_objects": Queue("untracked_objects", f"binary_label = '{POSITIVE_LABEL}' and cnn_features is not null", "sequence_id is null", True),
}


def scope(rows: DataFrame, queue: Queue) -> DataFrame:
    """The queue's rows: of one box, across all photos, the newest detection stands for all."""
    rows = rows.filter(queue.scope)
    if not queue.one_per_box:
        return rows
    newest = rows.groupBy("bbox").agg(F.max("id").alias("id"))
    return rows.join(newest.select("id"), "id", "left_semi")


def status(rows: DataFrame, queue: Queue) -> DataFrame:
    """One row: queue, unprocessed, queued, done. Open rows that wait are counted as queued as well."""
    waiting = F.col("in_queue").eqNullSafe(True)
    queued = waiting if queue.name == "source_images" else waiting & F.expr(queue.open)
    return scope(rows, queue).agg(F.count_if(F.expr(queue.open)).alias("unprocessed"), F.count_if(queued).alias("queued"), F.count_if(~F.expr(queue.open)).alias("done")).select(F.lit(queue.name).alias("queue"), "unprocessed", "queued", "done")


def status_table(images: DataFrame, detections: DataFrame) -> DataFrame:
    """The status of all queues, with a word for each: one pass over each table. The newest detection of a box
    in the scope of each queue is found in one aggregation by box."""
    out = status(images, QUEUES["source_images"])
    boxed = {name: queue for name, queue in QUEUES.items() if queue.one_per_box}
    state = lambda queue: F.struct("id", F.expr(queue.open).alias("open"), F.col("in_queue").eqNullSafe(True).alias("waits"))
    newest = detections.groupBy("bbox").agg(*[F.max(F.when(F.expr(queue.scope), state(queue))).alias(name) for name, queue in boxed.items()])
    count = lambda name: F.struct(F.lit(name).alias("queue"), F.count_if(F.col(name)["open"]).alias("unprocessed"), F.count_if(F.col(name)["open"] & F.col(name)["waits"]).alias("queued"), F.count_if(~F.col(name)["open"]).alias("done")).alias(name)
    out = out.unionByName(newest.agg(*[count(name) for name in boxed]).select(F.inline(F.array(*boxed))))
    word = F.when(F.col("queued") > 0, "Waiting").when(F.col("unprocessed") > 0, "Idle").otherwise("Done")
    return out.withColumn("status", word)


def global_counts(images: DataFrame, detections: DataFrame) -> DataFrame:
    """queue, queued, unprocessed over whole tables, without scopes: photos, objects without a binary label, and
    objects that have one but no species."""
    waits = F.col("in_queue").eqNullSafe(True)
    photos = images.agg(F.count_if(waits).alias("queued"), F.count_if(F.col("last_processed").isNull()).alias("unprocessed")).select(F.lit("images").alias("queue"), "queued", "unprocessed")
    kinds = {"unclassified_objects": F.col("binary_label").isNull(), "unclassified_species": F.col("specific_label").isNull() & F.col("binary_label").isNotNull()}
    counts = detections.agg(*[F.struct(F.lit(name).alias("queue"), F.count_if(waits & is_open).alias("queued"), F.count_if(is_open).alias("unprocessed")).alias(name) for name, is_open in kinds.items()])
    return photos.unionByName(counts.select(F.inline(F.array(*kinds))))


def set_flag(rows: DataFrame, ids: DataFrame, value: bool, when: Column | None = None) -> DataFrame:
    """in_queue of the rows with these ids (where `when`) set to `value`."""
    marked = rows.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    hit = F.col("__hit").isNotNull() if when is None else F.col("__hit").isNotNull() & F.coalesce(when, F.lit(False))
    return marked.withColumn("in_queue", F.when(hit, F.lit(value)).otherwise(F.col("in_queue"))).drop("__hit")


def add_unprocessed(rows: DataFrame, queue: Queue) -> DataFrame:
    """All open rows of the scope wait; except for photos, rows whose flag is null stay as they are."""
    when = F.col("in_queue").eqNullSafe(False) if queue.skips_null_flags else None
    return set_flag(rows, scope(rows, queue).filter(queue.open), True, when)


def clear(rows: DataFrame, queue: Queue) -> DataFrame:
    return set_flag(rows, scope(rows, queue), False)


def clear_all(images: DataFrame, detections: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with every queue cleared."""
    for queue in QUEUES.values():
        if queue.name == "source_images":
            images = clear(images, queue)
        else:
            detections = clear(detections, queue)
    return images, detections


def pull_with_previous(rows: DataFrame, queue: Queue, n: int, previous: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As `pull`, with previous_ids: the detections of the photo before, in order; `previous` has id and
    previous_image of the photos."""
    taken, after = pull(rows, queue, n)
    pairs = previous_frame_pairs(taken, rows, previous).groupBy("id").agg(F.sort_array(F.collect_list("previous_id")).alias("previous_ids"))
    return taken.join(pairs, "id", "left").withColumn("previous_ids", F.coalesce("previous_ids", F.array().cast("array<bigint>"))), after


def pull(rows: DataFrame, queue: Queue, n: int) -> tuple[DataFrame, DataFrame]:
    """(the first n waiting rows by id, the table in which they no longer wait)."""
    taken = scope(rows, queue).filter(F.col("in_queue").eqNullSafe(True)).filter(queue.open).filter(queue.pull).orderBy("id").limit(n)
    return taken, set_flag(rows, taken, False)


def enqueue(rows: DataFrame, ids: DataFrame) -> DataFrame:
    return set_flag(rows, ids, True)


def enqueue_session(rows: DataFrame, session_id: int) -> DataFrame:
    return rows.withColumn("in_queue", F.when(F.col("monitoring_session_id") == session_id, F.lit(True)).otherwise(F.col("in_queue")))


def fill_with_sample(rows: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """Unprocessed rows, drawn by a hash of their ids, wait until `size` do."""
    waiting = F.col("in_queue").eqNullSafe(True)
    missing = max(0, size - rows.filter(waiting).count())
    drawn = rows.filter(~waiting & F.col("last_processed").isNull()).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(missing)
    return set_flag(rows, drawn, True)
