"""Sources, sinks and streams."""

import json
import os
import struct
from datetime import datetime


import pytest

from duskframe import schemas
from duskframe.operators import sessions
from duskframe.plans import adapters, catalog, exports, snapshots
from duskframe.sources import images, taxa, tasks
from duskframe.streaming import sessions as stream_sessions
from duskframe.streaming import worker


def jpeg(width, height, taken=None):
    parts = [b"\xff\xd8"]
    if taken:
        text = taken.encode() + b"\x00"
        first = struct.pack("<HHHIII", 1, 0x8769, 4, 1, 26, 0)
        exif = struct.pack("<HHHIII", 1, 0x9003, 2, len(text), 44, 0)
        body = b"Exif\x00\x00" + b"II*\x00" + struct.pack("<I", 8) + first + exif + text
        parts.append(b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body)
    frame = struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00"
    parts.append(b"\xff\xc0" + struct.pack(">H", len(frame) + 2) + frame)
    return b"".join(parts) + b"\xff\xd9"


def test_scan(spark, tmp_path):
    (tmp_path / "night").mkdir()
    (tmp_path / "night" / "20220810231507-00.jpg").write_bytes(jpeg(40, 30))
    (tmp_path / "night" / "DSC_0390.JPG").write_bytes(jpeg(8, 6, "2022:07:19 14:28:16"))
    (tmp_path / "night" / "plain.jpeg").write_bytes(jpeg(4, 4))
    (tmp_path / "night" / "notes.txt").write_text("x")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in images.find_images(spark, str(tmp_path)).collect()}
    assert rows["20220810231507-00.jpg"]["timestamp"] == datetime(2022, 8, 10, 23, 15, 7)
    assert rows["DSC_0390.JPG"]["timestamp"] == datetime(2022, 7, 19, 14, 28, 16)
    assert tuple(rows["DSC_0390.JPG"]["shape"]) == (8, 6) and len(rows) == 2
    assert images.find_images(spark, str(tmp_path), skip_missing_timestamps=False).count() == 3


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "db")
    snapshots.create(spark, root, {"images": schemas.IMAGES})
    rows = spark.range(3).select("id")
    snapshots.swap(schemas.conform(rows, schemas.IMAGES), root, "images")
    assert snapshots.check(spark, root, ["images"]) == {"images": 3}
    snapshots.reset(spark, root, {"images": schemas.IMAGES}, str(tmp_path / "old"))
    assert snapshots.check(spark, root, ["images"]) == {"images": 0}
    assert snapshots.check(spark, str(tmp_path / "old"), ["images"]) == {"images": 3}


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a<b", [1.0, 2.0])], "id long, name string, box array<double>")
    for form in ("json", "csv", "html"):
        exports.export(rows, str(tmp_path / form), form)
    assert spark.read.schema(rows.schema).json(str(tmp_path / "json")).first()["box"] == [1.0, 2.0]
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["box"] == "[1.0,2.0]"
    assert "a&lt;b" in spark.read.text(str(tmp_path / "html")).first()["value"]


def test_track_file(spark, tmp_path):
    frame = {"event": "2022-01-01", "sequence": "s", "frame": 0, "image": 1, "id": 2, "path": "p", "binary_label": "moth", "specific_label": None, "specific_label_score": 0.5, "cost": None}
    (tmp_path / "t.json").write_text(json.dumps({"s": [frame, frame | {"frame": 1, "cost": 0.2}]}))
    assert taxa.read_track_file(spark, str(tmp_path / "t.json")).count() == 2


def test_worker(spark, tmp_path):
    path = tmp_path / "tasks.jsonl"
    path.write_text("".join(json.dumps({"id": str(i), "image_id": str(i), "image_url": "http://x/y.jpg" if i else None, "reply_subject": f"r{i}"}) + "\n" for i in range(3)))
    tasks.register(spark)
    assert spark.read.format("duskframe_tasks").option("path", str(path)).load().count() == 3
    stream = spark.readStream.format("duskframe_tasks").option("path", str(path)).option("split", 100).load()
    q = worker.run(stream, str(tmp_path / "out"), str(tmp_path / "state"), interval="0 seconds")
    q.processAllAvailable()
    q.stop()
    rows = {r["reply_subject"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(rows) == 3 and rows["r0"]["error"] and rows["r1"]["error"] is None
    m = worker.metrics(spark.read.parquet(str(tmp_path / "out"))).first()
    assert (m["total"], m["failed"]) == (3, 1)


def test_failing_batch_gives_errors(spark, tmp_path):
    tasks_df = spark.createDataFrame([("1", "1", "http://x/y", "r1")], "id string, image_id string, image_url string, reply_subject string")
    tasks_df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tasks_df.schema).parquet(str(tmp_path / "in"))

    def broken(df):
        raise RuntimeError("no model")

    worker.run(stream, str(tmp_path / "out"), str(tmp_path / "state"), broken).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["error"] == "no model"


def test_stream_sessions_equal_batch(spark, tmp_path):
    stamps = ["2022-01-01 20:00:00", "2022-01-02 01:59:59", "2022-01-02 07:59:59", "2022-01-03 08:04:59", "2022-02-01 00:00:00"]
    rows = spark.createDataFrame([(i, "a", datetime.fromisoformat(t)) for i, t in enumerate(stamps)], "id long, base_directory string, timestamp timestamp_ntz")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = stream_sessions.sessionize(stream).writeStream.outputMode("append").format("memory").queryName("closed").start()
    q.processAllAvailable()
    q.stop()
    found = {(r["session_ordinal"], r["num_images"]) for r in spark.table("closed").collect()}
    batch = {(r["session_ordinal"], r["count"]) for r in sessions.group_by_gap(rows).groupBy("session_ordinal").count().collect()}
    assert found == {x for x in batch if x[0] < 4}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_stream_sessions_of_the_events(spark):
    data = "/root/testdata/sf0.001"
    closed = {tuple(r) for r in catalog.QUERIES["stream_sessionize"](spark, data).collect()}
    rows = sessions.group_by_gap(adapters.captures(spark, data)).groupBy("base_directory", "session_ordinal").count().collect()
    last = {}
    for r in rows:
        last[r["base_directory"]] = max(last.get(r["base_directory"], 0), r["session_ordinal"])
    batch = {(r["base_directory"], r["session_ordinal"], r["count"]) for r in rows}
    assert closed <= batch and {x for x in batch if x[1] < last[x[0]]} <= closed


def test_names_of_photos_and_taxa(spark, tmp_path):
    (tmp_path / "night").mkdir()
    for name in ("a.jpg", "b.jpg"):
        (tmp_path / "night" / name).write_bytes(jpeg(4, 4))
    wanted = spark.createDataFrame([("night/b.jpg",), ("night/c.jpg",)], "path string")
    assert [r["path"].rsplit("/", 1)[1] for r in images.named_images(spark, str(tmp_path), wanted).collect()] == ["b.jpg"]
    (tmp_path / "taxa.tsv").write_text("taxonID\tcanonicalName\ttaxonRank\n" + "".join(f"{i % 3}\tname{i}\tspecies\n" for i in range(50)))
    assert {r["taxonID"]: r["canonicalName"] for r in taxa.read_taxa(spark, str(tmp_path / "taxa.tsv")).collect()} == {0: "name0", 1: "name1", 2: "name2"}
    jobs = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b")], "id int, pipeline_slug string")
    assert [r["id"] for r in tasks.jobs(jobs, ["a"]).collect()] == [1, 2]


def test_numbers_of_sessions_go_on_after_a_timeout(spark, tmp_path):
    """Files one at a time: a session that time closed does not give its number to the next one."""
    stamps = [("a", "2022-01-01 00:00:00"), ("b", "2022-01-05 00:00:00"), ("b", "2022-01-05 01:00:00"), ("a", "2022-01-06 00:00:00"), ("b", "2022-02-01 00:00:00"), ("b", "2022-02-02 00:00:00")]
    for i, (trap, t) in enumerate(stamps):
        rows = spark.createDataFrame([(i, trap, datetime.fromisoformat(t))], "id long, base_directory string, timestamp timestamp_ntz")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "id long, base_directory string, timestamp timestamp_ntz"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_sessions.sessionize(stream).writeStream.outputMode("append").format("memory").queryName("numbered").start()
    q.processAllAvailable()
    q.stop()
    found = sorted((r["base_directory"], r["session_ordinal"], r["num_images"]) for r in spark.table("numbered").collect())
    assert found[:3] == [("a", 1, 1), ("a", 2, 1), ("b", 1, 2)]
