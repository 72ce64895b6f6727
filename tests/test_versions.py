"""Tables with versions: pullers at once, upserts and retracking that touch few buckets."""

import datetime
import os
import random
import threading

import pytest
from pyspark.sql import functions as F
from test_tracker import tables

from duskframe.operators import queues, sessions, tracking, upserts
from duskframe.plans import maintenance
from duskframe.plans.versions import BUCKET, Conflict, VersionedTable

QUEUE = "id long, bbox array<double>, binary_label string, in_queue boolean"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def _files(root):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def test_eight_pullers_at_once(spark, tmp_path):
    n = 70
    rows = spark.range(n).select("id", F.array(*[(F.col("id") * k).cast("double") for k in (1, 2, 3, 4)]).alias("bbox"), F.lit(None).cast("string").alias("binary_label"), (F.col("id") % 7 != 3).alias("in_queue"))
    VersionedTable.create(rows, str(tmp_path / "t"), ["id"], 8)
    taken, errors, lock = [], [], threading.Lock()

    def puller():
        try:
            while (got := maintenance.pull(VersionedTable(spark, str(tmp_path / "t")), queues.QUEUES["detected_objects"], 6)) is not None:
                ids = [r["id"] for r in got.collect()]
                with lock:
                    taken.append(ids)
        except Exception as error:  # shown by the assertion below
            errors.append(error)

    threads = [threading.Thread(target=puller) for _ in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert sorted(i for ids in taken for i in ids) == [i for i in range(n) if i % 7 != 3]
    assert all(len(ids) <= 6 for ids in taken) and len(taken) >= 10
    after = VersionedTable(spark, str(tmp_path / "t"))
    assert after.read().filter("in_queue").count() == 0 and after.read().count() == n
    assert len(after._numbers()) == len(taken) + 1


def test_writers_of_other_buckets_do_not_meet(spark, tmp_path):
    table = VersionedTable.create(spark.range(100).withColumn("v", F.lit(0)), str(tmp_path / "t"), ["id"], 4)
    base = table.version()
    one, two = 0, 1
    assert table.commit(base, base.read([one]).withColumn("v", F.lit(1)), [one]).number == 1
    assert table.commit(base, base.read([two]).withColumn("v", F.lit(2)), [two]).number == 2
    assert table.commit(base, base.read([one]).withColumn("v", F.lit(3)), [one]) is None
    found = {(r[BUCKET], r["v"]) for r in table.version().read().collect()}
    assert found == {(0, 1), (1, 2), (2, 0), (3, 0)} and table.read().count() == 100
    assert base.read().filter("v != 0").count() == 0  # the old version is as it was
    with pytest.raises(ValueError, match="outside"):
        table.commit(table.version(), table.read(), [one])
    with pytest.raises(FileExistsError):
        VersionedTable.create(spark.range(1), str(tmp_path / "t"), ["id"], 4)

    def never(version):
        table.commit(version, version.read([one]), [one])
        return version.read([one]), [one], None

    with pytest.raises(Conflict):
        table.change(never, attempts=2)
    assert table.vacuum() > 0 and table.read().count() == 100 and len(table._numbers()) == 2


def test_a_version_is_put_once(spark, tmp_path, monkeypatch):
    """Also by the rename that other file systems than local ones get."""
    table = VersionedTable.create(spark.range(3), str(tmp_path / "t"), ["id"], 2)
    text = {"schema": table.version().schema.jsonValue(), "key": ["id"], "buckets": 2, "parts": {}}
    assert table._put(1, text) and not table._put(1, text)
    assert [f for f in os.listdir(tmp_path / "t/versions") if "draft" in f and not f.endswith(".crc")] == []


def test_upserts_rewrite_what_they_touch(spark, tmp_path):
    rows = spark.range(4000).select("id", F.floor(F.col("id") / 4).cast("long").alias("image_id"), F.array(F.lit(0.0), F.lit(0.0), F.lit(4.0), F.lit(5.0)).alias("bbox"), F.lit(20).alias("area_pixels"), F.lit(False).alias("in_queue"), F.lit("x").alias("specific_label"))
    root = str(tmp_path / "t")
    table = VersionedTable.create(rows, root, ["image_id"], 32)
    before = _files(root)
    found = spark.createDataFrame([(9001, 7, [0.0, 0.0, 2.0, 2.0]), (9002, 7, [0.0, 0.0, 3.0, 2.0])], "id long, image_id int, bbox array<double>")
    expected = upserts.replace_detections(table.read(), found)
    want = _rows(expected)
    maintenance.replace_detections(table, found)
    assert _rows(table.read().select(*expected.columns)) == want
    new = {p: s for p, s in _files(root).items() if p not in before}
    assert 0 < sum(new.values()) < sum(before.values()) / 16
    before = _files(root)
    changes = spark.createDataFrame([(9001, "moth"), (30, "gone"), (31, None), (123456, "none")], "id long, specific_label string")
    want = _rows(upserts.update_by_id(table.read(), changes))
    maintenance.update_by_id(table, changes)
    assert _rows(table.read()) == want
    new = {p: s for p, s in _files(root).items() if p not in before}
    assert 0 < sum(new.values()) < sum(before.values()) / 8
    versions = table._numbers()
    maintenance.update_by_id(table, changes.filter("id = 123456"))
    assert table._numbers() == versions


def test_retracking_of_stale_sessions(spark, tmp_path):
    i, d, days = tables(spark, 11, sessions=6, photos=6)
    d = d.join(i.select(F.col("id").alias("image_id"), "monitoring_session_id"), "image_id").withColumns({"sequence_id": F.lit(None).cast("string"), "sequence_frame": F.lit(None).cast("int"), "sequence_previous_id": F.lit(None).cast("long"), "sequence_previous_cost": F.lit(None).cast("double")})
    photos = VersionedTable.create(i, str(tmp_path / "i"), ["monitoring_session_id"], 16)
    rows = VersionedTable.create(d, str(tmp_path / "d"), ["monitoring_session_id"], 16)
    full = tracking.retrack(d, tracking.track(d, i, days, 30, 40))
    assert maintenance.retrack(rows, photos, days, 30, 40) > 1
    assert _rows(rows.read().select(*full.columns)) == _rows(full)
    assert maintenance.retrack(rows, photos, days, 30, 40) == 0
    before = rows.version()
    maintenance.late_photos(rows, spark.createDataFrame([(3,)], "session int"))
    cleared = rows.version()
    changed = [b for b in cleared.parts if cleared.parts[b] != before.parts.get(b)]
    assert len(changed) == 1 and rows.read().filter("sequence_id is not null and monitoring_session_id = 3").count() == 0
    scanned = cleared.read(changed).inputFiles()
    assert scanned and all(f"{BUCKET}={changed[0]}/" in f for f in scanned)
    assert maintenance.retrack(rows, photos, days, 30, 40) == 1
    assert _rows(rows.read().select(*full.columns)) == _rows(full)
    after = rows.version()
    assert [b for b in after.parts if after.parts[b] != before.parts.get(b)] == changed


def test_empty_tables(spark, tmp_path):
    table = VersionedTable.create(spark.createDataFrame([], QUEUE), str(tmp_path / "t"), ["id"], 4)
    assert table.read().count() == 0 and maintenance.pull(table, queues.QUEUES["detected_objects"], 3) is None
    maintenance.update_by_id(table, spark.createDataFrame([(1, True)], "id long, in_queue boolean"))
    assert table.version().number == 0


def test_aggregates_follow_inserts_and_deletes(spark):
    rng = random.Random(9)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randint(0, 60))
    images = [(i, rng.randint(1, 8), at() if rng.random() > 0.1 else None) for i in range(60)]
    objects = [(i, rng.randint(1, 8)) for i in range(50)]
    schema, known = "id long, monitoring_session_id long, timestamp timestamp_ntz", spark.createDataFrame([(s, f"d{s}") for s in range(1, 11)], "id long, base_directory string")
    frame = lambda rows: spark.createDataFrame(rows, schema)
    boxes = lambda rows: spark.createDataFrame(rows, "id long, monitoring_session_id long")
    kept = sessions.session_aggregates(known, frame(images), boxes(objects))
    for _ in range(3):
        gone = [r for r in images if r[1] == 3 or rng.random() < 0.3]
        new = [(1000 + i, rng.randint(1, 9), at()) for i in range(15)]
        lost, found = objects[:7], [(2000, 10), (2001, 99), (2002, 1)]
        images, objects = [r for r in images if r not in gone] + new, objects[7:] + found
        changes = spark.createDataFrame([(*r[1:], 1) for r in new] + [(*r[1:], -1) for r in gone], "monitoring_session_id long, timestamp timestamp_ntz, change int")
        moved = spark.createDataFrame([(r[1], 1) for r in found] + [(r[1], -1) for r in lost], "monitoring_session_id long, change int")
        rows = sessions.update_aggregates(kept, changes, moved, frame(images)).collect()
        full = sessions.session_aggregates(known, frame(images), boxes(objects))
        assert sorted(map(str, rows)) == sorted(map(str, full.select(*kept.columns).collect()))
        kept = spark.createDataFrame(rows, kept.schema)
