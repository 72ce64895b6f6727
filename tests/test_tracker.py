"""Tracks: the literal rule of features, and the streaming tracker against the batch."""

import datetime
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from duskframe.operators import tracking
from duskframe.streaming import tracker

DETECTIONS = "id long, image_id long, binary_label string, bbox array<double>, cnn_features array<double>"
IMAGES = "id long, monitoring_session_id long, timestamp timestamp_ntz"


def tables(spark, seed=1, sessions=3, photos=10, bare=0.15):
    rng = random.Random(seed)
    images, detections = [], []
    for s in range(sessions):
        base = datetime.datetime(2024, 1, 1 + s)
        spots = [(rng.uniform(0, 90), rng.uniform(0, 90), [rng.random() for _ in range(4)]) for _ in range(3)]
        for p in range(photos):
            image = 100 * s + p + 1
            images.append((image, s + 1, base + datetime.timedelta(minutes=p // 2)))  # equal times go by id
            for k in range(rng.choice([0, 1, 2, 3, 3])):
                x, y, f = spots[k]
                box = [x + rng.uniform(-3, 3), y + rng.uniform(-3, 3)]
                box = [*box, box[0] + 10, box[1] + 8] if rng.random() > 0.05 else None
                features = None if rng.random() < bare else [v + rng.uniform(0, 0.2) for v in f]
                detections.append((1000 * image + rng.randint(0, 9) + 10 * k, image, "moth" if rng.random() > 0.1 else "nonmoth", box, features))
    i, d = spark.createDataFrame(images, IMAGES), spark.createDataFrame(detections, DETECTIONS)
    days = i.groupBy(F.col("monitoring_session_id").alias("id")).agg(F.to_date(F.min("timestamp")).alias("day"))
    return i, d, days


def test_comparisons_end_at_the_first_object_without_features(spark):
    rows = [(1, 1, "moth", [0.0, 0.0, 9.0, 9.0], [1.0, 0.0]), (2, 1, "moth", [0.0, 0.0, 9.0, 9.0], None), (3, 1, "moth", [0.0, 0.0, 9.0, 9.0], [1.0, 0.0]), (4, 2, "moth", [0.0, 0.0, 9.0, 9.0], [1.0, 0.0]), (5, 2, "moth", [0.0, 0.0, 9.0, 9.0], []), (6, 2, "moth", [0.0, 0.0, 9.0, 9.0], [1.0, 0.0]), (7, 2, "nonmoth", [0.0, 0.0, 9.0, 9.0], None), (8, 3, "moth", [0.0, 0.0, 9.0, 9.0], [1.0, 0.0]), (9, 3, "nonmoth", None, None)]
    d = spark.createDataFrame(rows, DETECTIONS)
    i = spark.createDataFrame([(k, 1, datetime.datetime(2024, 1, 1, k)) for k in (1, 2, 3)], IMAGES)
    pairs = lambda in_order: {(r["id"], r["previous_id"]) for r in tracking.candidates(d.filter("id != 5 or " + ("true" if in_order else "false")), i, 30, 40, in_order=in_order).collect()}
    assert pairs(True) == {(4, 1), (8, 4)}
    assert pairs(False) == {(4, 1), (4, 3), (6, 1), (6, 3), (8, 4), (8, 6)}


def plain(i, d, in_order, threshold=1.0, diagonal=50.0):
    """Tracks by loops over photos, in order."""
    objects, out = {}, {}
    for r in sorted(d.collect(), key=lambda r: r["id"]):
        if r["binary_label"] == "moth":
            objects.setdefault(r["image_id"], []).append(Row(id=r["id"], bbox=r["bbox"], features=r["cnn_features"]))
    last = {}
    for image in sorted(i.collect(), key=lambda r: (r["timestamp"], r["id"])):
        now, before = objects.get(image["id"], []), last.get(image["monitoring_session_id"], [])
        for o in now:
            out[o.id] = (o.id, 0, None, None)
        for o in now:
            if not o.features:
                if in_order:
                    break
                continue
            best = None
            for b in before:
                if not b.features:
                    if in_order:
                        break
                    continue
                if o.bbox and b.bbox:
                    best = min(best or (9e9, 0), (round(float(tracker.pair_costs([o], [b], diagonal)[0, 0]), 9), b.id))
            if best and best[0] <= threshold:
                out[o.id] = (out[best[1]][0], out[best[1]][1] + 1, best[1], best[0])
        last[image["monitoring_session_id"]] = now
    return out


@pytest.mark.parametrize("in_order", [False, True])
def test_batch_tracks_equal_loops(spark, in_order):
    i, d, days = tables(spark, 7)
    want = plain(i, d, in_order)
    got = {r["id"]: (int(r["sequence_id"].rsplit("-", 1)[1]), r["sequence_frame"], r["sequence_previous_id"], r["sequence_previous_cost"]) for r in tracking.track(d, i, days, 30, 40, in_order=in_order).collect()}
    assert {k: v[:3] for k, v in got.items()} == {k: v[:3] for k, v in want.items()}
    assert sum(v[1] > 0 for v in got.values()) > 10
    assert all(got[k][3] == pytest.approx(want[k][3]) for k in want if want[k][3] is not None)


@pytest.mark.parametrize("in_order", [False, True])
def test_stream_with_late_photos_settles_as_the_batch(spark, tmp_path, in_order):
    i, d, days = tables(spark, 3)
    records = tracker.photos(i, d, days).collect()
    records.sort(key=lambda r: (r["at"], r["image_id"]))
    parts = [records[:9], records[9:18], records[18:]]
    late = next(r for r in parts[0] if r["session"] == 1)
    parts[0].remove(late)
    parts[2] = [*reversed(parts[2]), late]  # one session's first photo comes last; order within a batch doesn't matter
    for part in parts:
        spark.createDataFrame(part, tracker.PHOTO).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tracker.PHOTO).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    tracker.run(stream, str(tmp_path / "out"), str(tmp_path / "state"), 30, 40, in_order=in_order).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    got = spark.read.schema(tracker.TRACKED).parquet(str(tmp_path / "out"))
    assert [tuple(r) for r in got.filter("late").select("session", "image_id").collect()] == [(1, late["image_id"])]
    settled = tracker.settle(got, d, i, days, 30, 40, in_order=in_order)
    batch = tracking.track(d, i, days, 30, 40, in_order=in_order)
    assert sorted(map(tuple, settled.collect()), key=str) == sorted(map(tuple, batch.select(*settled.columns).collect()), key=str)


class _State:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class _Handle:
    def __init__(self):
        self.state, self.timers = _State(), []

    def getValueState(self, name, schema):
        return self.state

    def listTimers(self):
        return iter(self.timers)

    def registerTimer(self, at):
        self.timers.append(at)

    def deleteTimer(self, at):
        self.timers.remove(at)

    def getCurrentProcessingTimeInMs(self):
        return 1000


def test_a_silent_session_keeps_its_place_only():
    handle = _Handle()
    t = tracker.Tracker(50.0, 1.0, 5000, False)
    t.init(handle)
    photo = lambda image, at: Row(session=1, day="20240101", image_id=image, at=at, objects=[{"id": image, "bbox": [0.0, 0.0, 9.0, 9.0], "features": [1.0]}])
    rows = lambda *p: list(t.handleInputRows((1,), iter(p), handle))
    assert [(r.id, r.root, r.late) for r in rows(photo(2, 20), photo(1, 10))] == [(1, 1, False), (2, 1, False)]
    assert handle.timers == [6000] and handle.state.value[2] and len(handle.state.value[3]) == 1
    assert [r.late for r in rows(photo(1, 10), photo(9, None), photo(3, 20))] == [True, True, False]
    assert handle.timers == [6000]
    assert list(t.handleExpiredTimer((1,), handle, None)) == []
    assert handle.state.value == (20, 3, False, [])
    assert [r.late for r in rows(photo(4, 30))] == [True]


def test_a_timer_needs_an_interval(spark, tmp_path):
    stream = spark.readStream.schema(tracker.PHOTO).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="interval"):
        tracker.run(stream, "out", "state", 30, 40, idle=datetime.timedelta(days=1))
