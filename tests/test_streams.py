"""The task source, the result sink and jobs."""

import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from duskframe.operators import sessions
from duskframe.sources import results, tasks
from duskframe.streaming import sessions as stream_sessions
from duskframe.streaming import worker

TASKS = "id string, image_id string, image_url string, reply_subject string"


def _line(i):
    return json.dumps({"id": str(i), "image_id": f"é{i}", "image_url": None if i % 5 == 0 else "http://x/y.jpg", "reply_subject": f"r{i}"}) + "\n"


def one_box(images):
    return images.select(F.col("id").alias("source_image_id"))


def test_every_line_is_in_one_split(tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text("\n" + "".join(_line(i) + ("\n" if i % 9 == 0 else "") for i in range(60)) + '{"id": "61", "unfinished')
    end = tasks._end(str(path))
    assert path.read_bytes()[:end].endswith(b"\n") and b"unfinished" in path.read_bytes()[end:]
    for size in (1, 7, 63, 64, 500, 10**6):
        got = [t[0] for s in tasks._splits(0, end, size) for t in tasks._tasks(str(path), s)]
        assert got == [str(i) for i in range(60)]
    assert tasks._end(str(tmp_path / "none")) == 0
    (tmp_path / "one").write_text("no end")
    assert tasks._end(str(tmp_path / "one")) == 0


def test_tasks_are_read_in_splits_and_not_again_after_a_restart(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text("".join(_line(i) for i in range(100)))
    tasks.register(spark)
    size = path.stat().st_size
    rows = spark.read.format("duskframe_tasks").option("path", str(path)).option("split", -(-size // 4)).load()
    assert rows.rdd.getNumPartitions() == 4 and rows.count() == 100
    seen = []

    def run():
        stream = spark.readStream.format("duskframe_tasks").option("path", f"file://{path}").option("split", size // 4 + 1).load()

        def each(batch, number):
            seen.append((number, batch.rdd.getNumPartitions(), [r["id"] for r in batch.collect()]))

        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="0 seconds").start()
        query.processAllAvailable()
        query.stop()

    run()
    assert sorted(int(i) for _, _, ids in seen for i in ids) == list(range(100))
    assert len(seen) == 1 and seen[0][1] == 4
    with path.open("a") as more:
        more.write("".join(_line(i) for i in range(100, 130)))
    before = len(seen)
    run()
    assert sorted(int(i) for _, _, ids in seen[before:] for i in ids) == list(range(100, 130))


def test_a_failed_batch_leaves_no_result(spark, tmp_path):
    results.register(spark)
    root = str(tmp_path / "r")
    rows = spark.range(20).selectExpr("if(id % 10 = 0, null, concat('r', id)) as reply_subject", "cast(id as string) as image_id", "id as n_detections", "cast(null as string) as error").repartition(4)
    put = lambda df, n: df.write.format("duskframe_results").option("path", root).option("batch", n).mode("append").save()
    put(rows, 0)
    got = results.results(spark, root, worker.RESULT)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.filter("reply_subject is not null").collect()))
    put(rows, 0)  # the same batch again
    broken = rows.withColumn("n_detections", F.when(F.col("image_id") == "7", F.raise_error(F.lit("no"))).otherwise(F.col("n_detections")).cast("long"))
    with pytest.raises(Exception, match="no"):
        put(broken, 1)
    assert results.results(spark, root, worker.RESULT).count() == 18
    put(rows, 1)
    assert results.results(spark, root, worker.RESULT).count() == 36
    assert [(r["batch"], r["accepted"], r["dropped"]) for r in results.batches(spark, root).orderBy("batch").collect()] == [(0, 18, 2), (1, 18, 2)]


def test_the_sink_as_a_stream(spark, tmp_path):
    results.register(spark)
    root = str(tmp_path / "r")
    for k in range(3):
        spark.range(5).selectExpr(f"concat('r', id + {5 * k}) as reply_subject", "'i' as image_id", "id as n_detections", "cast(null as string) as error").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(worker.RESULT).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.format("duskframe_results").option("path", root).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(int(r[0][1:]) for r in results.results(spark, root, worker.RESULT).select("reply_subject").collect()) == list(range(15))
    assert results.batches(spark, root).count() == 3


def test_totals_of_jobs(spark, tmp_path):
    results.register(spark)
    jobs = {}
    for job, n in (("moths", 23), ("flies", 8), ("broken", 4)):
        rows = spark.createDataFrame([tuple(json.loads(_line(i)).values()) for i in range(n)], TASKS)
        rows.repartition(2).write.parquet(str(tmp_path / job / "in"))
        jobs[job] = spark.readStream.schema(TASKS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / job / "in"))
    jobs["stopped"] = spark.readStream.schema(TASKS).parquet(str(tmp_path / "moths" / "in")).withColumn("id", F.raise_error(F.lit("unreadable")).cast("string"))

    def broken(images):
        raise RuntimeError("no model")

    done = worker.run_jobs(jobs, str(tmp_path), {"moths": one_box, "flies": one_box, "broken": broken, "stopped": one_box})
    for job, n in (("moths", 23), ("flies", 8), ("broken", 4)):
        assert done.totals[job]["tasks"] == n and done.totals[job]["unusable"] == len(range(0, n, 5)) and done.totals[job]["batches"] == 2
        got = results.results(spark, str(tmp_path / job / "results"), worker.RESULT).collect()
        assert sorted(int(r["reply_subject"][1:]) for r in got) == list(range(n))
        assert {r["error"] for r in got} == ({"no model"} if job == "broken" else {None, "image could not be opened"})
    assert not done.running and not [q for q in spark.streams.active if q.name in jobs]
    assert set(done.failed) <= {"stopped"}
    assert os.path.isdir(tmp_path / "moths" / "state")


CAPTURES = "id long, base_directory string, timestamp timestamp_ntz"


def test_tasks_count_once_however_often_a_batch_is_made(spark, tmp_path):
    """A cached batch can be lost, or made by several executors; here the pipeline clears the cache."""
    results.register(spark)
    spark.createDataFrame([tuple(json.loads(_line(i)).values()) for i in range(23)], TASKS).repartition(2).write.parquet(str(tmp_path / "in"))

    def forgets(images):
        spark.catalog.clearCache()
        return one_box(images)

    done = worker.run_jobs({"moths": spark.readStream.schema(TASKS).parquet(str(tmp_path / "in"))}, str(tmp_path), {"moths": forgets})
    assert done.totals == {"moths": {"tasks": 23, "unusable": 5, "batches": 1}}
    assert results.results(spark, str(tmp_path / "moths" / "results"), worker.RESULT).count() == 23


def _replay(spark, place, batches):
    for rows in batches:
        spark.createDataFrame(rows, CAPTURES).coalesce(1).write.mode("append").parquet(f"{place}/in")
    stream = spark.readStream.schema(CAPTURES).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")
    stream_sessions.run(stream, f"{place}/out", f"{place}/state").awaitTermination()


def test_all_sessions_of_a_stream_equal_the_batch(spark, tmp_path):
    """Gaps of the limit to the microsecond; traps that begin late, fall silent, and hold most captures."""
    rng, rows, start = random.Random(4), [], datetime.datetime(2024, 3, 1)
    for trap, steps in (("hot", 400), ("a", 40), ("b", 12), ("one", 1)):
        t = start + datetime.timedelta(hours=rng.randint(0, 30))
        for _ in range(steps):
            rows.append((len(rows), trap, t))
            t += rng.choice([datetime.timedelta(0), datetime.timedelta(minutes=3), datetime.timedelta(minutes=359, seconds=59, microseconds=999_999), datetime.timedelta(hours=6), datetime.timedelta(minutes=200), datetime.timedelta(days=2)])
    rows.sort(key=lambda r: r[2])
    cuts = [0, 3, 150, 151, 300, len(rows)]
    batches = [rng.sample(rows[a:z], z - a) for a, z in zip(cuts, cuts[1:])]
    batches[2].append((9999, "a", None))
    _replay(spark, tmp_path, batches)
    batch = sessions.group_by_gap(spark.createDataFrame(rows, CAPTURES)).groupBy("base_directory", "session_ordinal").agg(F.min("timestamp").alias("start_time"), F.max("timestamp").alias("end_time"), F.count("*").alias("num_images"))
    got = stream_sessions.sessions(spark, str(tmp_path / "out"), still_open=True)
    key = lambda df: sorted(map(tuple, df.select("base_directory", "session_ordinal", F.col("start_time").cast("timestamp_ntz"), F.col("end_time").cast("timestamp_ntz"), "num_images").collect()))
    assert key(got) == key(batch)
    closed = stream_sessions.sessions(spark, str(tmp_path / "out"))
    assert set(map(tuple, closed.select("base_directory", "session_ordinal").collect())) < set(map(tuple, got.select("base_directory", "session_ordinal").collect()))


def test_numbers_go_on_after_silence(spark, tmp_path):
    at = lambda day, hour=0: datetime.datetime(2024, 1, day, hour)
    _replay(spark, tmp_path, [[(1, "a", at(1))], [(2, "b", at(5)), (3, "b", at(5, 1))], [(4, "a", at(6)), (5, "a", at(6, 2))], [(6, "b", at(20))]])
    rows = stream_sessions.sessions(spark, str(tmp_path / "out")).collect()
    assert sorted((r["base_directory"], r["session_ordinal"], r["num_images"]) for r in rows) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 2)]
    rows = stream_sessions.sessions(spark, str(tmp_path / "out"), still_open=True).collect()
    assert ("b", 2, 1) in {(r["base_directory"], r["session_ordinal"], r["num_images"]) for r in rows} and len(rows) == 4


def test_a_batch_meets_few_rows_of_a_trap(spark):
    """Ten thousand captures of one day are five stretches at most."""
    rows = spark.range(10_000).selectExpr("'t' as base_directory", "id * 8640000 as at")
    gap = 360 * 60_000_000
    found = stream_sessions.stitch(spark.createDataFrame([], stream_sessions._OPEN), rows, gap)
    (row,) = found.collect()
    assert (row["n"], row["a"], row["z"], row["session_ordinal"], row["last"]) == (10_000, 0, 9999 * 8640000, 1, True)
