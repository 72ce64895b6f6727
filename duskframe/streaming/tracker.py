"""Tracks of a stream of photos, with state for each session: the objects of its last photo.

A photo is one record with its positive detections. Photos of a session come in order of (time, id); each is
met with the one before it, by the rules of `operators.tracking`. A photo that is not after the last one is late:
tracks that are given out already would change, so its session is named late and is tracked anew by a batch job
(`settle`). In a stream that goes on, a timer drops the boxes and features that are held for a session once it has
been silent for `idle`, and keeps the place of its last photo alone; photos that still come are late then.
"""

from __future__ import annotations

import datetime
import math
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions import strings
from ..operators import tracking
from ..schemas import POSITIVE_LABEL, TRACKING_COST_THRESHOLD

OBJECT = "struct<id:long,bbox:array<double>,features:array<double>>"
#: A photo: its session, the session's day as text of eight digits, its place in time (microseconds) and its objects.
PHOTO = f"session long, day string, image_id long, at long, objects array<{OBJECT}>"
#: A row for each positive detection; for a late photo one row without an id.
TRACKED = "session long, day string, image_id long, late boolean, id long, root long, sequence_frame int, sequence_previous_id long, sequence_previous_cost double"
_STATE = "at long, image_id long, held boolean, objects array<struct<id:long,bbox:array<double>,features:array<double>,root:long,frame:int>>"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def photos(images: DataFrame, detections: DataFrame, sessions: DataFrame, key: str = "monitoring_session_id") -> DataFrame:
    """Photo records (PHOTO) of tables. Photos without a session are left out, those without objects are not."""
    mine = detections.filter(F.col("binary_label") == POSITIVE_LABEL)
    object_ = F.struct(F.col("id").cast("long").alias("id"), F.col("bbox").cast("array<double>").alias("bbox"), F.col("cnn_features").cast("array<double>").alias("features"))
    objects = mine.groupBy("image_id").agg(F.sort_array(F.collect_list(object_)).alias("objects"))
    rows = images.select(F.col("id").alias("image_id"), F.col(key).alias("session"), F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"))
    days = sessions.select(F.col("id").alias("session"), F.date_format("day", "yyyyMMdd").alias("day"))
    rows = rows.join(days, "session").join(objects, "image_id", "left")
    return rows.select("session", "day", "image_id", "at", F.coalesce("objects", F.array().cast(f"array<{OBJECT}>")).alias("objects"))


def _rounded(cost: float) -> float:
    """To 9 places, halves up, by the shortest digits of the number."""
    return float(Decimal(repr(cost)).quantize(Decimal("1e-9"), ROUND_HALF_UP))


def pair_costs(current: list, previous: list, diagonal: float) -> np.ndarray:
    """Costs of all pairs of two photos' objects; NaN where they cannot be compared. Sums run in order, as in `functions.vectors`."""
    total = lambda x: np.cumsum(x, axis=-1)[..., -1]
    box = lambda rows: np.array([r.bbox for r in rows], float).T
    a, b = box(current)[:, :, None], box(previous)[:, None, :]
    area = lambda c: (c[2] - c[0] + 1) * (c[3] - c[1] + 1)
    both = np.maximum(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]) + 1, 0.0) * np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]) + 1, 0.0)
    with np.errstate(all="ignore"):
        iou = np.rint(both / (area(a) + area(b) - both) * 100) / 100
        ratio = np.minimum(area(a), area(b)) / np.maximum(area(a), area(b))
        dx, dy = (a[0] + a[2]) / 2.0 - (b[0] + b[2]) / 2.0, (a[1] + a[3]) / 2.0 - (b[1] + b[3]) / 2.0
        far = np.sqrt(dx * dx + dy * dy) / diagonal
        like = np.full(far.shape, np.nan)
        before = {}  # of each length: which objects, their features and lengths of vectors
        for n in {len(r.features) for r in previous} - {0}:
            which = [j for j, r in enumerate(previous) if len(r.features) == n]
            rows = np.array([previous[j].features for j in which], float)
            before[n] = which, rows, np.sqrt(total(rows * rows))
        for i, r in enumerate(current):  # one row at a time: a photo's features in all pairs would not fit
            mine = np.array(r.features, float)
            if len(mine) in before:
                which, rows, norms = before[len(mine)]
                norms = math.sqrt(total(mine * mine)) * norms
                like[i, which] = total(mine * rows) / np.where(norms == 0, np.nan, norms)
        return (1 - like) + (1 - iou) + (1 - ratio) + far


def comparable(objects: list, in_order: bool) -> list:
    """Objects that take part in comparisons: those with a box and features; `in_order` ends at the first without features."""
    out = []
    for x in objects:
        if not x.features:
            if in_order:
                break
        elif x.bbox is not None:
            out.append(x)
    return out


class Tracker(StatefulProcessor):
    def __init__(self, diagonal: float, threshold: float, idle_ms: int | None, in_order: bool):
        self.diagonal, self.threshold, self.idle_ms, self.in_order = diagonal, threshold, idle_ms, in_order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = self.last.get()  # None of a new session
        at, image, held, objects = last or (None, None, True, [])
        objects = [Row(id=o[0], bbox=o[1], features=o[2], root=o[3], frame=o[4]) for o in objects or []]
        batch = list(rows)
        batch.sort(key=lambda p: (p.at is not None, p.at or 0, p.image_id))
        for p in batch:
            if p.at is None or not held or (at is not None and (p.at, p.image_id) <= (at, image)):
                yield Row(session=key[0], day=p.day, image_id=p.image_id, late=True, id=None, root=None, sequence_frame=None, sequence_previous_id=None, sequence_previous_cost=None)
                continue
            found = []
            for o, parent, cost in self.match([Row(**o) for o in p.objects or []], objects):  # inner structs come as dictionaries
                root, frame = (parent.root, parent.frame + 1) if parent else (o.id, 0)
                found.append(Row(id=o.id, bbox=o.bbox, features=o.features, root=root, frame=frame))
                yield Row(session=key[0], day=p.day, image_id=p.image_id, late=False, id=o.id, root=root, sequence_frame=frame, sequence_previous_id=parent.id if parent else None, sequence_previous_cost=cost)
            at, image, objects = p.at, p.image_id, found
        if held and at is not None:
            self.last.update((at, image, True, [tuple(o) for o in objects]))
            if self.idle_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def match(self, current: list, previous: list) -> Iterator[tuple]:
        """(object, its parent or None, cost or None) of all objects of a photo."""
        mine, others = comparable(current, self.in_order), comparable(previous, self.in_order)
        chosen = {}
        if mine and others:
            for o, row in zip(mine, pair_costs(mine, others, self.diagonal), strict=True):
                if np.isnan(row).all():
                    continue
                near = np.flatnonzero(row <= np.nanmin(row) + 2e-9)
                cost, _, j = min((_rounded(float(row[j])), others[j].id, j) for j in near)
                if cost <= self.threshold:
                    chosen[o.id] = (others[j], cost)
        for o in current:
            yield o, *chosen.get(o.id, (None, None))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            at, image, _, _ = self.last.get()
            self.last.update((at, image, False, []))
        yield from ()

    def close(self) -> None:
        pass


def track(stream: DataFrame, width: int, height: int, threshold: float = TRACKING_COST_THRESHOLD, idle: datetime.timedelta | None = None, in_order: bool = False) -> DataFrame:
    """Rows of TRACKED of a stream of photos (PHOTO). Sessions are dealt by their ids; a task holds the photos of one
    session in one batch at a time, and the objects of its last photo. With `idle` the stream has timers, so it must
    have an interval: a query that is to end with its input would go on for them."""
    processor = Tracker(float(math.ceil(math.sqrt(width * width + height * height))), threshold, None if idle is None else int(idle.total_seconds() * 1000), in_order)
    return stream.groupBy("session").transformWithState(processor, TRACKED, "append", "none" if idle is None else "processingTime")


def run(stream: DataFrame, out: str, checkpoint: str, width: int, height: int, interval: str | None = None, **options) -> StreamingQuery:
    """Write the rows of `track` to Parquet files under `out`. Without `interval` the query ends when no photo is left;
    it can't have `idle` then.
    The state is kept in RocksDB; the session's own choice of a state store comes back once the query has begun."""
    if interval is None and options.get("idle") is not None:
        raise ValueError("idle needs an interval")
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        writer = track(stream, width, height, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def late_sessions(tracked: DataFrame) -> DataFrame:
    """Sessions (session) that must be tracked anew."""
    return tracked.filter("late").select("session").distinct()


def columns(tracked: DataFrame) -> list[Column]:
    """The track columns of detections."""
    name = strings.track_id(F.to_date("day", "yyyyMMdd"), F.col("root"))
    return [F.col("id"), name.alias("sequence_id"), F.col("sequence_frame"), F.col("sequence_previous_id"), F.col("sequence_previous_cost")]


def settle(tracked: DataFrame, detections: DataFrame, images: DataFrame, sessions: DataFrame, width: int, height: int, threshold: float = TRACKING_COST_THRESHOLD, key: str = "monitoring_session_id", in_order: bool = False) -> DataFrame:
    """Tracks (columns as of `operators.tracking.track`) of all sessions of a stream: its rows, but for late sessions,
    whose tracks are computed anew from the tables."""
    late = late_sessions(tracked)
    anew = images.join(late.select(F.col("session").alias(key)), key, "left_semi")
    there = detections.join(anew.select(F.col("id").alias("image_id")), "image_id", "left_semi")
    again = tracking.track(there, anew, sessions, width, height, threshold, key, in_order)
    done = tracked.filter(~F.col("late")).join(late, "session", "left_anti")
    return done.select(*columns(done)).unionByName(again)
