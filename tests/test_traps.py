"""Small fixtures for rules that are easy to get wrong."""

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from duskframe.functions import geometry, strings, times, vectors
from duskframe.operators import dedupe, inference, occurrences, queues, sessions, tracking, upserts
from duskframe.operators import detections as objects

T = lambda s: datetime.fromisoformat(s)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def _captures(spark, stamps):
    return spark.createDataFrame([(i, "a", T(t)) for i, t in enumerate(stamps)], "id long, base_directory string, timestamp timestamp_ntz")


STAMPS = ["2022-01-01 20:00:00", "2022-01-02 01:59:59", "2022-01-02 07:59:59", "2022-01-03 08:04:59"]


def test_gap_of_exactly_the_maximum_splits(spark):
    rows = sessions.group_by_gap(_captures(spark, STAMPS)).orderBy("id").collect()
    assert [r["session_ordinal"] for r in rows] == [1, 1, 2, 3]


def test_wrapped_gap_ignores_days(spark):
    rows = sessions.group_by_gap(_captures(spark, STAMPS), wrap_days=True).orderBy("id").collect()
    assert [r["session_ordinal"] for r in rows] == [1, 1, 2, 2]


def test_two_sessions_of_one_day(spark):
    c = _captures(spark, ["2022-01-01 01:00:00", "2022-01-01 09:00:00"])
    assert sessions.group_by_gap(c).count() == 2
    assert [r["id"] for r in sessions.group_by_gap(c, last_of_day=True).collect()] == [1]


def _duplicates(spark):
    rows = [("a", 1, None), ("a", 2, T("2022-01-02")), ("a", 3, T("2022-01-01")), ("b", 4, None), ("b", 5, None), ("c", 6, T("2022-01-01"))]
    return spark.createDataFrame(rows, "path string, id long, timestamp timestamp_ntz")


def test_retention(spark):
    kept = lambda **k: sorted(r["id"] for r in dedupe.retention(_duplicates(spark), **k).filter("keep").collect())
    assert kept() == [3, 4]
    assert kept(nulls_first=True) == [1, 4]
    assert sorted(r["id"] for r in dedupe.delete_duplicates(_duplicates(spark)).collect()) == [1, 2, 5]
    left = dedupe.delete_duplicates(_duplicates(spark), dry_run=False)
    assert sorted(r["id"] for r in left.collect()) == [3, 4, 6]
    assert dedupe.groups(left).count() == 0


COSTS = [
    ([0, 0, 9, 9], [0, 0, 9, 9], [1, 0], [1, 0], 0.0), ([0, 0, 9, 9], [5, 0, 14, 9], [1, 0], [1, 0], 0.77), ([0, 0, 9, 9], [5, 0, 14, 9], [1, 0], [1, 1], 1.0629),
    ([0, 0, 9, 9], [0, 0, 9, 4], [1, 1], [1, 1], 1.05), ([0, 0, 9, 9], [20, 20, 29, 29], [1, 0], [1, 0], 1.5657),
]


@pytest.mark.parametrize("a,b,f,g,expected", COSTS)
def test_costs(spark, a, b, f, g, expected):
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    cost = tracking.total_cost(lit(f), lit(g), lit(a), lit(b), geometry.diagonal(F.lit(30.0), F.lit(40.0)))
    assert one(spark, cost) == pytest.approx(expected, abs=1e-4)


def test_tracks_are_trees(spark):
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    links = spark.createDataFrame([(2, 1, 0.1), (3, 2, 0.1), (4, 3, 0.1), (5, 2, 0.1)], "id long, previous_id long, cost double")
    rows = {r["id"]: (r["root"], r["frame"]) for r in tracking.resolve_tracks(ids, links).collect()}
    assert rows == {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (1, 3), 5: (1, 2)}


def test_long_chain(spark):
    n = 300
    ids = spark.range(n).toDF("id")
    links = spark.range(1, n).select("id", (F.col("id") - 1).alias("previous_id"), F.lit(0.5).alias("cost"))
    rows = tracking.resolve_tracks(ids, links)
    assert rows.filter("root != 0 or frame != id").count() == 0 and rows.count() == n


def _queue(spark):
    rows = [(1, [0.0, 0.0, 5.0, 5.0], None, True), (2, [0.0, 0.0, 5.0, 5.0], None, True), (3, [1.0, 1.0, 4.0, 4.0], "moth", False), (4, [2.0, 2.0, 4.0, 4.0], None, None), (5, None, None, True)]
    return spark.createDataFrame(rows, "id long, bbox array<double>, binary_label string, in_queue boolean")


def test_queue(spark):
    q, rows = queues.QUEUES["detected_objects"], _queue(spark)
    assert sorted(r["id"] for r in queues.scope(rows, q).collect()) == [2, 3, 4]
    s = queues.status(rows, q).first()
    assert (s["unprocessed"], s["queued"], s["done"]) == (2, 1, 1)
    flags = lambda df: {r["id"]: r["in_queue"] for r in df.collect()}
    assert flags(queues.add_unprocessed(rows, q)) == flags(rows)
    taken, after = queues.pull(rows, q, 5)
    assert [r["id"] for r in taken.collect()] == [2]
    assert flags(after) == {1: True, 2: False, 3: False, 4: None, 5: True}


def test_names(spark):
    assert one(spark, strings.slugify(F.lit("Big  Moth - (2)!"))) == "big_moth_2"
    assert one(spark, strings.slugify(F.lit(" a   b "))) == "a__b"
    assert one(spark, strings.track_display_name(F.lit("20220101-SEQ-7"))) == "SEQ-7"
    assert one(spark, strings.track_display_name(F.lit(None).cast("string"))) == ""
    for name, stamp in {"20220810231507-00-07.jpg": "2022-08-10 23:15:07", "84-20220916202959-snapshot.jpg": "2022-09-16 20:29:59", "DSC_0390.JPG": None}.items():
        assert str(one(spark, times.timestamp_in_name(F.lit(f"/x/{name}")).cast("string"))) == str(stamp)


def test_label_rules(spark):
    rule = lambda s: one(spark, vectors.label_or_binary(F.lit("luna"), F.lit(s).cast("double"), F.lit("moth"), -1.0))
    assert [rule(0.0), rule(None), rule(0.5)] == ["moth", "moth", "luna"]
    assert one(spark, vectors.kept_boxes(F.array(F.array(F.lit(1.9)), F.array(F.lit(2.0))), F.array(F.lit(0.6), F.lit(0.5)), 0.5)) == [[1]]


def test_null_scores_fail_any_threshold(spark):
    d = spark.createDataFrame([(1, 1, "t", None, T("2022-01-01")), (2, 1, "u", 0.5, T("2022-01-01"))], "id long, monitoring_session_id long, sequence_id string, specific_label_score double, timestamp timestamp_ntz")
    assert [r["sequence_id"] for r in occurrences.track_summary(d, -1.0).collect()] == ["u"]


def test_last_wins(spark):
    rows = spark.createDataFrame([(0, "a", 1), (1, "b", 2), (2, "a", 3)], "place long, id string, v int")
    assert sorted(map(tuple, objects.last_wins(rows, "id", "place").collect())) == [(0, "a", 3), (1, "b", 2)]


def test_pipeline_shapes(spark):
    images = spark.createDataFrame([(str(i),) for i in range(30)], "id string")
    rows = inference.process(images).collect()
    assert rows
    for r in rows:
        c = r["classifications"]
        assert c[0]["classification"] in ("moth", "nonmoth") and c[-1]["terminal"]
        assert len(c) == (2 if c[0]["classification"] == "moth" else 1)
        assert all(len(x["scores"]) == len(x["logits"]) == len(x["labels"]) for x in c)
    assert len(inference.algorithms()) == 3 and len(inference.algorithms(binary=None)) == 2
    assert inference.process(images.limit(0)).count() == 0


def test_upserts_repeat_safely(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    new = spark.createDataFrame([(2, "z"), (3, "w")], "id long, v string")
    once = upserts.insert_missing(old, new, ["id"])
    assert sorted(map(tuple, once.collect())) == [(1, "x"), (2, "y"), (3, "w")]
    assert sorted(map(tuple, upserts.insert_missing(once, new, ["id"]).collect())) == sorted(map(tuple, once.collect()))


def test_signs_of_coordinates(spark):
    dms = lambda v: tuple(one(spark, geometry.degrees_minutes_seconds(F.lit(v))))
    assert dms(-12.5) == (-12, -30, 0.0) and dms(12.5) == (12, 30, 0.0)
    d, m, s = dms(-0.51)
    assert (d, m) == (0, -30) and s == pytest.approx(-36.0)
    assert one(spark, geometry.compass(F.lit(0.5), "N", "S")) == "S"


def test_latest_positive_per_box(spark):
    rows = [(1, 7, [1.0], "moth", T("2022-01-03")), (2, 7, [1.0], "moth", T("2022-01-01")), (3, 7, [1.0], "nonmoth", T("2022-01-09")), (4, 7, None, "moth", T("2022-01-01")), (5, 7, None, "moth", T("2022-01-02")), (6, 8, [1.0], None, T("2022-01-01"))]
    df = spark.createDataFrame(rows, "id long, image_id long, bbox array<double>, binary_label string, last_detected timestamp_ntz")
    assert sorted(r["id"] for r in objects.latest_per_box(df).collect()) == [1, 5]


def test_counts_of_queues(spark):
    images = spark.createDataFrame([(True, None), (False, T("2022-01-01")), (None, None)], "in_queue boolean, last_processed timestamp_ntz")
    found = spark.createDataFrame([(True, None, None), (False, None, None), (True, "moth", None), (True, "nonmoth", "x"), (None, "moth", None)], "in_queue boolean, binary_label string, specific_label string")
    assert {r["queue"]: (r["queued"], r["unprocessed"]) for r in queues.global_counts(images, found).collect()} == {"images": (1, 2), "unclassified_objects": (1, 2), "unclassified_species": (1, 2)}


def test_one_long_session(spark):
    """Neighbours of 20,000 photos of one session, in time in proportion to their number."""
    rows = spark.range(20_000).selectExpr("id", "1 as monitoring_session_id", "timestamp_ntz'2022-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, cast(id div 2 as int), 0) as timestamp")
    began = time.time()
    out = {r["id"]: (r["previous_image"], r["next_image"]) for r in sessions.neighbours(rows).collect()}
    assert time.time() - began < 20
    assert out[0] == (None, 2) and out[1] == (None, 2) and out[10] == (9, 12) and out[19_999] == (19_997, None)


def test_softmax_and_norm(spark):
    s = one(spark, vectors.softmax(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))))
    assert s == pytest.approx([0.0900306, 0.2447285, 0.6652410], abs=1e-6)
    assert one(spark, vectors.l1_normalize(F.array(F.lit(1.0), F.lit(3.0)))) == [0.25, 0.75]
    assert one(spark, vectors.softmax(F.lit(None).cast("array<double>"))) is None


def test_status_of_all_queues_equals_each(spark):
    rows = [(i, [0.0, 0.0, float(i % 5), 1.0] if i % 4 else None, [None, "moth", "nonmoth"][i % 3], [None, "sp"][i % 2], [True, False, None][i % 7 % 3], [None, 1][i % 6 % 2], [None, "s"][i % 8 // 5]) for i in range(90)]
    x = spark.createDataFrame(rows, "id long, bbox array<double>, binary_label string, specific_label string, in_queue boolean, cnn_features int, sequence_id string")
    i = spark.createDataFrame([(1, None, True), (2, None, False), (3, datetime(2024, 1, 1), None)], "id long, last_processed timestamp_ntz, in_queue boolean")
    table = {r["queue"]: tuple(r)[:4] for r in queues.status_table(i, x).collect()}
    assert table == {name: tuple(queues.status(i if name == "source_images" else x, q).first()) for name, q in queues.QUEUES.items()}
    empty = queues.status_table(i.limit(0), x.limit(0)).collect()
    assert len(empty) == 5 and all(tuple(r)[1:] == (0, 0, 0, "Done") for r in empty)


def test_strict_costs_fail_out_of_range(spark):
    """Without `strict` such pairs have a cost, with it they are an error."""
    lit = lambda v: F.array(*[F.lit(float(x)) for x in v])
    far = [lit([1, 0]), lit([1, 0]), lit([0, 0, 9, 9]), lit([90, 90, 99, 99]), F.lit(50.0)]
    against = [lit([1, 0]), lit([-1, 0]), lit([0, 0, 9, 9]), lit([0, 0, 9, 9]), F.lit(50.0)]
    for args, word in ((far, "diagonal"), (against, "cosine")):
        assert one(spark, tracking.total_cost(*args)) > 1
        with pytest.raises(Exception, match=word):
            one(spark, tracking.total_cost(*args, strict=True))
    near = [lit([1, 0]), lit([1, 1]), lit([0, 0, 9, 9]), lit([1, 0, 9, 9]), F.lit(50.0)]
    assert one(spark, tracking.total_cost(*near, strict=True)) == one(spark, tracking.total_cost(*near))


def test_names_of_models_and_services(spark):
    assert one(spark, strings.model_key(F.lit(None).cast("string"), F.lit("My Model - v 2"))) == one(spark, strings.slugify(F.lit("My Model - v 2")))
    assert one(spark, strings.model_key(F.lit("key"), F.lit("x"))) == "key"
    assert one(spark, strings.service_name(F.lit("worker"), F.lit("host1"))) == "worker (host1)"


def test_an_instant_of_a_local_time(spark):
    local = F.lit("2024-03-01 22:30:00").cast("timestamp_ntz")
    assert one(spark, F.unix_timestamp(times.with_offset(local, "-04:00")) - F.unix_timestamp(times.with_offset(local))) == 4 * 3600


def test_a_new_classification_replaces_that_of_its_algorithm(spark):
    kind = "struct<classification:string,algorithm:struct<name:string,key:string>>"
    make = lambda label, key: F.struct(F.lit(label).alias("classification"), F.struct(F.lit(key.upper()).alias("name"), F.lit(key).alias("key")).alias("algorithm")).cast(kind)
    old = F.array(make("a", "x"), make("b", "y"), make("c", "x"))
    found = one(spark, vectors.replace_classification(old, make("new", "x")))
    assert [(c["classification"], c["algorithm"]["key"]) for c in found] == [("b", "y"), ("new", "x")]
    assert [c["classification"] for c in one(spark, vectors.replace_classification(F.array().cast(f"array<{kind}>"), make("new", "x")))] == ["new"]
