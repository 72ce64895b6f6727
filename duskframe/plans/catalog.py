"""The queries of the catalogue; `oracle` has their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import geometry, strings, times, vectors
from ..operators import dedupe, inference, occurrences, queues, sessions, tracking, upserts
from ..operators import detections as objects
from ..scratch import shared_root
from ..sources import results, taxa
from ..streaming import sessions as stream_sessions
from ..streaming import tracker as stream_tracker
from ..streaming import worker
from . import adapters as a
from . import exports, maintenance
from .versions import VersionedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _aggregates(spark, d):
    return sessions.session_aggregates(a.sessions(spark, d), a.images(spark, d), a.detections(spark, d))


@query
def occurrence_summary(spark, d):
    o = occurrences.occurrences(a.detections(spark, d), 0.2)
    ids = F.array_join(F.transform("examples", lambda e: e["id"].cast("string")), ",")
    return o.select("monitoring_session_id", "sequence_id", "name", "label", F.round("best_score", 6).alias("best_score"), "num_detections", "duration_us", ids.alias("example_ids"))


@query
def occurrences_limited(spark, d):
    return occurrences.occurrences(a.detections(spark, d), -1.0, 1, 3).select("monitoring_session_id", "sequence_id", "num_detections", "label")


@query
def deployment_summary(spark, d):
    return sessions.deployments(_aggregates(spark, d))


@query
def session_aggregates(spark, d):
    s, e = F.col("start_time"), F.col("end_time")
    return _aggregates(spark, d).select("id", "num_images", "num_detected_objects", times.microseconds_between(s, e).alias("duration_us"), times.duration_minutes(s, e).alias("duration_minutes"))


@query
def session_report(spark, d):
    return sessions.session_report(_aggregates(spark, d)).drop("duration_label")


@query
def session_distincts(spark, d):
    return sessions.session_distincts(a.detections(spark, d), 0.3)


def _sessionized(spark, d, **options):
    return sessions.group_by_gap(a.captures(spark, d), **options).select("id", "base_directory", "session_ordinal", F.col("session_day").cast("string").alias("session_day"))


@query
def sessionize_gap(spark, d):
    return _sessionized(spark, d)


@query
def sessionize_gap_wrapped(spark, d):
    return _sessionized(spark, d, wrap_days=True)


@query
def sessionize_last_per_day(spark, d):
    return _sessionized(spark, d, last_of_day=True)


@query
def list_species(spark, d):
    return occurrences.list_species(a.detections(spark, d), 0.3)


@query
def species_counts(spark, d):
    return objects.species_counts(a.detections(spark, d)).withColumn("mean_score", F.round("mean_score", 6))


@query
def species_max_area(spark, d):
    return objects.species_areas(a.detections(spark, d))


@query
def unique_species(spark, d):
    return objects.unique_species(a.detections(spark, d))


@query
def classification_results(spark, d):
    return objects.classification_results(a.detections(spark, d), 0.4)


@query
def classification_summary(spark, d):
    return objects.summarize_results(objects.classification_results(a.detections(spark, d), 0.4)).select("label", "count", F.round("mean_score", 6).alias("mean_score"))


@query
def detections_filtered_page(spark, d):
    return objects.filtered_page(a.detections(spark, d), a.sessions(spark, d), 0.5, 100, 50).select("id", "monitoring_session_id", F.col("day").cast("string").alias("day"))


@query
def image_object_counts(spark, d):
    return objects.image_counts(a.detections(spark, d), 0.3)


@query
def completely_classified(spark, d):
    return objects.completely_classified(a.images(spark, d), objects.image_counts(a.detections(spark, d)))


@query
def track_info(spark, d):
    i = occurrences.track_info(a.detections(spark, d))
    return i.select("sequence_id", F.date_format("start_time", "yyyy-MM-dd HH:mm:ss").alias("start_time"), "minutes", "frames")


@query
def tracks_collected(spark, d):
    t = occurrences.collect_tracks(a.detections(spark, d))
    return t.select("monitoring_session_id", "sequence_id", F.array_join(F.transform("frames", lambda f: F.concat(f["frame"].cast("string"), F.lit(":"), f["id"].cast("string"))), " ").alias("frames"))


@query
def single_frame_tracks(spark, d):
    return occurrences.single_frame_tracks(a.detections(spark, d))


@query
def broken_tracks(spark, d):
    # Turns as frames, with a number left out after every third.
    c = a.table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("sequence_id"), (F.col("turn") + F.floor(F.col("turn") / 3)).alias("sequence_frame"), F.col("turn").alias("id"))
    return occurrences.broken_tracks(c).select("sequence_id", "sequence_frame", F.col("expected_frame").cast("long").alias("expected_frame"))


@query
def occurrences_by_label(spark, d):
    o = occurrences.by_label(a.detections(spark, d))
    return o.select("sequence_id", "specific_label", "count", times.microseconds_between(F.col("first_seen"), F.col("last_seen")).alias("span_us"))


@query
def avg_detections_per_image(spark, d):
    return objects.detections_per_image(a.detections(spark, d), a.images(spark, d)).withColumn("average", F.round("average", 6))


@query
def orphan_detections(spark, d):
    lines = a.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return objects.orphans(lines, a.table(spark, d, "orders").filter("o_orderstatus != 'F'").select("o_orderkey"), "l_orderkey", "o_orderkey")


@query
def missing_tracks(spark, d):
    return objects.missing_tracks(a.detections(spark, d)).select("id", "image_id")


@query
def neighbour_images(spark, d):
    return sessions.neighbours(a.images(spark, d)).select("id", "previous_image", "next_image")


@query
def previous_frame_pairs(spark, d):
    return objects.previous_frame_pairs(a.detections(spark, d), a.detections(spark, d), sessions.neighbours(a.images(spark, d)))


@query
def cyclic_neighbour(spark, d):
    return sessions.cyclic_neighbours(a.images(spark, d)).select("id", "next_id", "previous_id")


@query
def best_sibling(spark, d):
    return objects.best_siblings(a.detections(spark, d)).select("id", "best_id")


@query
def cover_photo(spark, d):
    return sessions.cover_photo(a.images(spark, d))


@query
def mid_session_sample(spark, d):
    return sessions.mid_session_sample(a.images(spark, d), 2).select("monitoring_session_id", "id", F.col("place").cast("long").alias("place"))


@query
def duplicate_groups(spark, d):
    return dedupe.groups(a.captures(spark, d)).select("id", "path", "group_size")


@query
def duplicate_retention(spark, d):
    return dedupe.retention(a.captures(spark, d)).select("id", "path", "keep")


@query
def duplicate_retention_nulls_first(spark, d):
    c = a.captures(spark, d).withColumn("timestamp", F.when(F.col("id") % 7 != 0, F.col("timestamp")))
    return dedupe.retention(c, nulls_first=True).select("id", "path", "keep")


@query
def duplicate_deletes(spark, d):
    return dedupe.delete_duplicates(a.captures(spark, d)).select("id")


@query
def duplicate_survivors(spark, d):
    return dedupe.delete_duplicates(a.captures(spark, d), dry_run=False).select("id", "path")


@query
def unique_bbox_latest(spark, d):
    return objects.latest_per_box(a.detections(spark, d)).select("id", "image_id")


@query
def bbox_dedup_scope(spark, d):
    return queues.scope(a.detections(spark, d), queues.QUEUES["detected_objects"]).select("id")


def _queued(spark, d):
    """Detections as the queues see them: features known by id."""
    return a.detections(spark, d).withColumn("cnn_features", F.col("feature_id"))


@query
def queue_status(spark, d):
    return queues.status_table(a.images(spark, d), _queued(spark, d))


@query
def queue_counts_global(spark, d):
    return queues.global_counts(a.images(spark, d), a.detections(spark, d))


@query
def queue_clear_all(spark, d):
    return queues.clear_all(a.images(spark, d), _queued(spark, d))[1].select("id", "in_queue")


@query
def queue_pull_pairs(spark, d):
    taken = queues.pull_with_previous(_queued(spark, d), queues.QUEUES["untracked_objects"], 20, sessions.neighbours(a.images(spark, d)))[0]
    return taken.select("id", F.array_join(F.transform("previous_ids", lambda x: x.cast("string")), ",").alias("previous_ids"))


@query
def queue_pull_n(spark, d):
    return queues.pull(_queued(spark, d), queues.QUEUES["unclassified_objects"], 20)[0].select("id")


@query
def queue_after_pull(spark, d):
    return queues.pull(_queued(spark, d), queues.QUEUES["unclassified_objects"], 20)[1].select("id", "in_queue")


@query
def queue_add_unprocessed(spark, d):
    return queues.add_unprocessed(_queued(spark, d), queues.QUEUES["untracked_objects"]).select("id", "in_queue")


@query
def queue_clear(spark, d):
    return queues.clear(_queued(spark, d), queues.QUEUES["unclassified_objects"]).select("id", "in_queue")


@query
def queue_enqueue_session(spark, d):
    return queues.enqueue_session(a.images(spark, d), 1001).select("id", "in_queue")


@query
def bbox_geometry(spark, d):
    x = a.detections(spark, d).filter("bbox is not null")
    b = F.col("bbox")
    return x.select("id", geometry.area(b).alias("area"), F.get(geometry.center(b), 0).alias("cx"), F.get(geometry.center(b), 1).alias("cy"), F.get(geometry.relative(b, F.lit(1200.0), F.lit(800.0)), 2).alias("right"), geometry.diagonal(F.lit(1200.0), F.lit(800.0)).cast("long").alias("diagonal"), geometry.is_empty(b).alias("empty"))


@query
def box_pairs(spark, d):
    x = a.detections(spark, d).filter("bbox is not null")
    y = x.select((F.col("id") + 1).alias("id"), F.col("bbox").alias("other"))
    b, o = F.col("bbox"), F.col("other")
    return x.join(y, "id").select("id", geometry.iou(b, o).alias("iou"), F.round(geometry.size_ratio(b, o), 6).alias("ratio"), F.round(geometry.distance_ratio(b, o, F.lit(1443.0)), 6).alias("distance"))


@query
def l1_normalize(spark, d):
    f = a.features(spark, d).withColumn("n", vectors.l1_normalize(F.col("cnn_features")))
    return f.select("feature_id", F.round(F.get("n", 0), 9).alias("first"), F.round(vectors.total(F.col("n")), 6).alias("total"))


@query
def softmax_argmax(spark, d):
    e = a.table(spark, d, "embeddings").withColumn("s", vectors.softmax(F.col("embedding")))
    return e.select("vec_id", vectors.argmax(F.col("s")).alias("best"), F.round(F.array_max("s"), 6).alias("score"))


@query
def cosine_neighbours(spark, d):
    e = a.table(spark, d, "embeddings")
    o = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(o, "vec_id").select("vec_id", F.round(vectors.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


def _traps(spark, d):
    """Detections, photos and sessions, one session for each trap, so that tracks run through all its days."""
    x = a.detections(spark, d).withColumn("monitoring_session_id", F.col("user_id"))
    i = a.images(spark, d).withColumn("monitoring_session_id", F.col("user_id"))
    s = i.groupBy(F.col("monitoring_session_id").alias("id")).agg(F.to_date(F.min("timestamp")).alias("day"))
    return x, i, s


def _tracked(spark, d):
    """The same, detections with features."""
    x, i, s = _traps(spark, d)
    return x.join(a.features(spark, d), "feature_id", "left"), i, s


@query
def tracking_costs(spark, d):
    x, i, _ = _tracked(spark, d)
    return tracking.candidates(x, i, a.WIDTH, a.HEIGHT).withColumn("cost", F.round("cost", 6))


@query
def tracking_parents(spark, d):
    x, i, _ = _tracked(spark, d)
    return tracking.parents(tracking.candidates(x, i, a.WIDTH, a.HEIGHT), 1.75).withColumn("cost", F.round("cost", 6))


@query
def tracking_sequences(spark, d):
    x, i, s = _tracked(spark, d)
    t = tracking.track(x, i, s, a.WIDTH, a.HEIGHT, 1.75)
    return t.withColumn("sequence_previous_cost", F.round("sequence_previous_cost", 6))


@query
def tracking_parents_in_order(spark, d):
    """The literal rule: comparisons of a photo end at its first object without features."""
    x, i, _ = _tracked(spark, d)
    return tracking.parents(tracking.candidates(x, i, a.WIDTH, a.HEIGHT, in_order=True), 1.75).withColumn("cost", F.round("cost", 6))


@query
def tracking_sequences_in_order(spark, d):
    x, i, s = _tracked(spark, d)
    t = tracking.track(x, i, s, a.WIDTH, a.HEIGHT, 1.75, in_order=True)
    return t.withColumn("sequence_previous_cost", F.round("sequence_previous_cost", 6))


def _replayed(spark, d, name, batches, **options):
    """All photos as a stream, in order of time, in so many batches; the tracker's rows. A batch has as many files as
    Spark has cores; a session's photos of one part of the time lie in one file, so they come in order wherever a batch ends."""
    x, i, s = _tracked(spark, d)
    root = _place(spark, name)
    rows = stream_tracker.photos(i, x, s)
    ends = rows.agg(F.min("at").alias("a"), F.max("at").alias("z")).first()
    part = F.floor((F.col("at") - ends.a) * batches / (ends.z - ends.a + 1)).cast("int")
    files = spark.sparkContext.defaultParallelism
    rows.withColumn("part", part).write.partitionBy("part").parquet(f"{root}/photos")
    for k in range(batches):  # a file's time decides when it is read
        spark.read.schema(stream_tracker.PHOTO).parquet(f"{root}/photos/part={k}").repartition(files, "session").write.mode("append").parquet(f"{root}/in")
    stream = spark.readStream.schema(stream_tracker.PHOTO).option("maxFilesPerTrigger", files).parquet(f"{root}/in")
    stream_tracker.run(stream, f"{root}/out", f"{root}/state", a.WIDTH, a.HEIGHT, threshold=1.75, **options).awaitTermination()
    return spark.read.schema(stream_tracker.TRACKED).parquet(f"{root}/out")


@query
def stream_tracking(spark, d):
    """Tracks of all photos, replayed as a stream in ten batches."""
    t = _replayed(spark, d, "tracker", 10)
    return t.filter("not late").select(*stream_tracker.columns(t)).withColumn("sequence_previous_cost", F.round("sequence_previous_cost", 6))


@query
def stale_sessions(spark, d):
    return tracking.stale_sessions(a.detections(spark, d))


@query
def detection_upsert(spark, d):
    x = a.detections(spark, d).select("id", "image_id", "bbox", "area_pixels", "in_queue")
    found = x.filter("id % 50 = 0").select((F.col("id") + 10_000_000).alias("id"), "image_id", "bbox")
    return upserts.replace_detections(x, found).select("id", "image_id", "area_pixels", "in_queue")


@query
def classification_update(spark, d):
    x = a.detections(spark, d)
    changes = x.filter("id % 4 = 0").select("id", F.concat(F.lit("new_"), (F.col("id") % 3).cast("string")).alias("specific_label"), F.when(F.col("id") % 8 == 0, F.lit(0.99)).alias("specific_label_score"))
    return upserts.update_by_id(x, changes).select("id", "specific_label", "specific_label_score")


@query
def session_upsert(spark, d):
    s = a.sessions(spark, d).select("id", "base_directory", "day")
    known = s.filter("id % 3 != 0")
    return upserts.insert_missing(known, s, ["base_directory", "day"]).select("id", "base_directory", F.col("day").cast("string").alias("day"))


@query
def scan_upsert(spark, d):
    """All photos are scanned; of two traps in three every fourth one is new."""
    i = a.images(spark, d)
    names = ["id", "base_directory", "path"]
    return upserts.add_scanned(i.filter("id % 4 != 0 or user_id % 3 = 0").select(names), i.select(names), ["base_directory"])


@query
def delete_of_image(spark, d):
    return upserts.delete_of_image(a.detections(spark, d), 100003).select("id", "image_id")


@query
def slugify(spark, d):
    t = a.table(spark, d, "part").select("p_partkey", F.concat("p_type", F.lit(" - "), "p_brand", F.lit("  "), "p_name").alias("t"))
    return t.select("p_partkey", strings.slugify(F.col("t")).alias("slug"), strings.split_label(F.col("t")).alias("label"))


@query
def filename_timestamp(spark, d):
    name = F.concat(F.lit("/cam/"), (F.col("event_id") % 7).cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("-snapshot.jpg"))
    name = F.when(F.col("event_id") % 9 == 0, F.lit("/cam/DSC_0390.JPG")).when(F.col("event_id") % 11 == 0, F.concat(F.lit("/cam/"), F.date_format("ts", "yyyy_MM_dd"), F.lit(".jpg"))).otherwise(name)
    return a.table(spark, d, "events").select("event_id", F.date_format(times.timestamp_in_name(name), "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query
def url_basename(spark, d):
    return a.table(spark, d, "pages").select("page_id", strings.url_basename(F.col("url")).alias("name"))


@query
def coordinates_dms(spark, d):
    v = F.col("c_acctbal") / 60.0
    dms = geometry.degrees_minutes_seconds(v)
    return a.table(spark, d, "customer").select("c_custkey", dms["degrees"].alias("degrees"), dms["minutes"].alias("minutes"), (F.round(dms["seconds"], 2) + 0.0).alias("seconds"), geometry.compass(v, "N", "S").alias("side"))


@query
def taxon_lookup(spark, d):
    p = a.table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise((F.col("p_partkey") % 40).cast("string")).alias("label"))
    return taxa.name_labels(p, a.table(spark, d, "nation"), "label", "n_nationkey", "n_name")


@query
def json_props(spark, d):
    return a.table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query
def source_dedup_last_wins(spark, d):
    e = a.table(spark, d, "events").select(F.col("event_id").alias("place"), F.col("user_id").alias("id"), "value")
    return inference.unique_images(e)


@query
def positive_negative_split(spark, d):
    x = a.detections(spark, d).withColumn("labels", F.array("binary_label", "specific_label"))
    yes, no = objects.split_by_first(x)
    return yes.select("id", F.lit("positive").alias("side")).unionByName(no.select("id", F.lit("negative").alias("side")))


@query
def overlay_labels(spark, d):
    return a.detections(spark, d).select("id", vectors.overlay_label(F.col("binary_label"), F.col("specific_label"), F.col("specific_label_score"), 0.4, "nonmoth").alias("overlay"))


@query
def reported_labels(spark, d):
    r = vectors.reported_label(F.col("specific_label"), F.col("specific_label_score"), F.col("binary_label"), F.col("binary_label_score"))
    return a.detections(spark, d).select("id", r["label"].alias("label"), r["score"].alias("score"))


@query
def absolute_paths(spark, d):
    i = a.images(spark, d)
    return i.select("id", strings.absolute_path(F.col("base_directory"), F.when(F.col("id") % 3 == 0, F.concat("base_directory", F.lit("/"), "path")).when(F.col("id") % 3 == 1, F.col("path"))).alias("path"))


@query
def labels_threshold_split(spark, d):
    rows = a.table(spark, d, "labels").join(a.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return rows.groupBy("quality").agg(F.count("*").alias("count"), F.count_if(F.coalesce("toxic", F.lit(0)) >= 1).alias("marked"), F.max("n_chars").alias("longest"))


@query
def frame_counter(spark, d):
    """"k of n" for each detection of a track."""
    return occurrences.frame_counter(a.detections(spark, d)).select("id", "counter")


@query
def objects_for_species(spark, d):
    return objects.of_species(a.detections(spark, d), "species_3", 1001).select("id", "monitoring_session_id").unionByName(objects.of_species(a.detections(spark, d), "species_4").select("id", "monitoring_session_id"))


@query
def sessions_by_day(spark, d):
    rows = sessions.by_days(_aggregates(spark, d), ["2024-01-01", "2024-01-08"])
    return rows.select("id", "num_images", "num_detected_objects")


@query
def timestamped_folders(spark, d):
    from ..sources import images

    e = a.table(spark, d, "events").select(F.concat(F.lit("/data/"), F.date_format("ts", "yyyy_MM_dd"), F.lit("/x_y/"), F.col("event_id").cast("string"), F.lit(".jpg")).alias("path"))
    return images.timestamped_folders(e).select("name", F.col("day").cast("string").alias("day"))


@query
def category_maps(spark, d):
    n = a.table(spark, d, "nation").select("n_nationkey", F.concat(F.lit('{"'), F.col("n_name"), F.lit('": '), F.col("n_nationkey").cast("string"), F.lit(', "other": 99}')).alias("text"))
    m = n.withColumn("m", taxa.read_category_map(F.col("text")))
    return m.select("n_nationkey", F.array_join(vectors.category_rows(F.col("m")), "|").alias("labels"), F.element_at("m", F.lit(99)).alias("last"))


@query
def decoded_payloads(spark, d):
    """Base64 payloads, with and without a data URI, and the name that their bytes give."""
    t = a.table(spark, d, "documents").select("doc_id", F.base64(F.encode("text", "utf-8")).alias("b"))
    payload = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("data:image/png;base64,"), "b")).otherwise(F.col("b"))
    return t.select("doc_id", F.md5(strings.decode_base64(payload)).alias("name"))


@query
def batch_shapes(spark, d):
    """Distinct image sizes of each batch of 8 tasks."""
    e = a.table(spark, d, "events").select(F.floor(F.col("event_id") / 8).alias("batch"), (F.col("event_id") % 3).alias("width"), (F.floor(F.col("event_id") / 16) % 2).alias("height"))
    return e.groupBy("batch").agg(F.count_distinct("width", "height").alias("shapes"))


@query
def time_labels(spark, d):
    e = a.table(spark, d, "events")
    end = F.timestamp_add("SECOND", (F.col("event_id") * 977 % 200000).cast("int"), F.col("ts"))
    return e.select("event_id", times.duration_label(F.col("ts"), end).alias("label"), times.clock_label((F.col("event_id") * 977 % 200000)).alias("clock"))


@query
def crop_names(spark, d):
    x = a.detections(spark, d).filter("bbox is not null")
    return x.select("id", strings.crop_name(F.col("path"), F.col("bbox"), F.lit("20240101")).alias("name"))


@query
def capture_details(spark, d):
    """Photos with the detections that they hold."""
    rows = sessions.capture_details(a.images(spark, d), a.sessions(spark, d), objects.list_items(a.detections(spark, d)))
    shown = F.transform("detections", lambda x: F.concat_ws(":", x["id"].cast("string"), x["label"], x["area_pixels"].cast("string")))
    return rows.select("id", "path", "filesize", F.col("event").cast("string").alias("event"), F.array_join(shown, ",").alias("objects"))


@query
def detection_report(spark, d):
    r = objects.report(a.detections(spark, d), a.images(spark, d), a.sessions(spark, d))
    return r.select("id", "deployment", "session", "session_id", "sequence", "sequence_frame", "source_image_path", "cropped_image_path", "timestamp", F.get("bbox_center", 0).alias("center_x"), "area_pixels", "label", "score", "in_queue")


@query
def sessions_in_order(spark, d):
    """Sessions of one trap, numbered in order of start."""
    rows = sessions.in_order(_aggregates(spark, d), "/traps/trap_7")
    return rows.select("id", F.col("day").cast("string").alias("day"), F.row_number().over(Window.partitionBy("base_directory").orderBy(F.asc_nulls_last("start_time"), "id")).cast("long").alias("place"))


@query
def sessions_page_by_day(spark, d):
    """The second page of all sessions in order of day."""
    return sessions.in_order(_aggregates(spark, d), by="day").offset(20).limit(20).select("id", F.col("day").cast("string").alias("day"))


@query
def detection_list(spark, d):
    """The simple row of each detection."""
    rows = objects.list_items(a.detections(spark, d))
    return rows.select("id", "image_id", "cropped_image_path", geometry.box_text(F.col("bbox")).alias("bbox"), "area_pixels", F.date_format("last_detected", "yyyy-MM-dd HH:mm:ss").alias("last_detected"), "label", "score", "in_queue")


@query
def sessions_known(spark, d):
    return sessions.count_known(a.sessions(spark, d), "/traps/trap_7")


@query
def captures_page(spark, d):
    return sessions.captures(a.images(spark, d).withColumn("monitoring_session_id", F.col("user_id")), 7, 20, 5).select("id", "path")


@query
def missing_source_data(spark, d):
    i = a.images(spark, d)
    x = a.detections(spark, d).select("id", "image_id", F.when(F.col("id") % 2 == 0, F.col("timestamp")).alias("timestamp"), F.when(F.col("id") % 3 != 0, 5).alias("source_image_width"), F.when(F.col("id") % 5 != 0, 5).alias("source_image_height"), F.col("image_id").alias("source_image_previous_frame"))
    lost = objects.missing_sizes(i.withColumns({"width": F.when(F.col("id") % 4 != 0, 5), "height": F.when(F.col("id") % 6 != 0, 5)}))
    return objects.missing_source_data(x).select("id").unionByName(lost.select((-F.col("id")).alias("id")))


@query
def batch_previous(spark, d):
    """The photo before in the same batch of photos."""
    return sessions.previous_in_batch(a.images(spark, d).withColumn("batch", F.col("id") % 97), "batch").select("id", "previous_image")


@query
def box_of_json(spark, d):
    x = a.detections(spark, d).select("id", F.to_json("bbox").alias("text"))
    return x.select("id", geometry.area(geometry.box_of_json(F.col("text"))).alias("area"))


@query
def batch_plan(spark, d):
    """Per user: batches of 8 that the events fill, and seconds for each event."""
    e = a.table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").alias("seconds"))
    return e.select("user_id", times.batches(F.col("n"), 8).alias("batches"), F.round(times.seconds_per_item(F.col("seconds"), F.col("n")), 6).alias("per_item"))


@query
def classification_examples(spark, d):
    """How many examples a label has, and whether they are its own."""
    results = objects.classification_results(a.detections(spark, d), 0.4)
    own = results.groupBy(F.col("label").alias("l")).agg(F.collect_set("path").alias("own"))
    rows = objects.summarize_results(results).join(own, F.col("label").eqNullSafe(F.col("l")))
    return rows.select("label", F.size("examples").cast("long").alias("examples"), (F.size(F.array_except("examples", "own")) == 0).alias("known"))


@query
def schema_downgrade(spark, d):
    """Detections in the form that they had before tracking."""
    rows = schemas.drop_tracking(schemas.conform(a.detections(spark, d), schemas.DETECTIONS))
    return rows.select(F.col("id"), "image_id", "path", "specific_label", F.lit(len(rows.columns)).cast("long").alias("width"))


@query
def queue_fill_sample(spark, d):
    """The queue is filled to 400; which rows are drawn is a matter of hashes, so they are counted."""
    rows = queues.fill_with_sample(a.images(spark, d).withColumn("in_queue", F.col("id") % 50 == 0), 400)
    return rows.agg(F.count("*").alias("images"), F.count_if("in_queue").alias("queued"), F.count_if(F.col("in_queue") & F.col("last_processed").isNotNull() & (F.col("id") % 50 != 0)).alias("wrong"))


@query
def mark_processed(spark, d):
    i = a.images(spark, d)
    rows = upserts.mark_processed(i, i.filter("id % 3 = 0"), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz"))
    return rows.select("id", F.date_format("last_processed", "yyyy-MM-dd HH:mm:ss").alias("last_processed"))


@query
def backfill_from_images(spark, d):
    """Detections whose times and sizes are missing, filled from their photos."""
    i = a.images(spark, d).withColumns({"width": F.lit(a.WIDTH), "height": F.lit(a.HEIGHT)})
    x = a.detections(spark, d).select("id", "image_id", F.when(F.col("id") % 2 == 0, F.col("timestamp")).alias("timestamp"), F.lit(None).cast("int").alias("source_image_width"), F.when(F.col("id") % 3 == 0, 5).alias("source_image_height"), F.lit(None).cast("long").alias("source_image_previous_frame"))
    rows = upserts.fill_from_images(x, i, sessions.neighbours(a.images(spark, d)))
    return rows.select("id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "source_image_width", "source_image_height", "source_image_previous_frame")


@query
def retracked(spark, d):
    """Track columns replaced for the detections that have new tracks; the others keep theirs."""
    x = a.detections(spark, d).withColumns({"sequence_previous_id": F.lit(None).cast("long"), "sequence_previous_cost": F.lit(None).cast("double")})
    t = x.filter("id % 6 = 0").select("id", F.lit("new").alias("sequence_id"), F.lit(0).alias("sequence_frame"), F.col("image_id").alias("sequence_previous_id"), F.lit(0.5).alias("sequence_previous_cost"))
    return tracking.retrack(x, t).select("id", "sequence_id", "sequence_frame", "sequence_previous_id", "sequence_previous_cost")


@query
def process_pipeline(spark, d):
    r = inference.process(a.images(spark, d).select(F.col("id").cast("string").alias("id")))
    return r.select("source_image_id", geometry.box_text(F.col("bbox")).alias("bbox"), F.array_join(F.transform("classifications", lambda c: c["classification"]), ",").alias("labels"))


def _stream(spark, d, name):
    """A table as a stream of its files, to the end of what is there."""
    return spark.readStream.schema(a.table(spark, d, name).schema).parquet(f"{d}/{name}*.parquet")


def _place(spark, name):
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def stream_worker(spark, d):
    """A task for each page, as a stream; one in seven has no address and gives an error."""
    n = F.col("page_id")
    tasks = _stream(spark, d, "pages").select(n.cast("string").alias("id"), n.cast("string").alias("image_id"), F.when(n % 7 != 3, F.col("url")).alias("image_url"), F.concat(F.lit("r"), n.cast("string")).alias("reply_subject"))
    root = _place(spark, "worker")
    worker.run(tasks, f"{root}/out", f"{root}/state").awaitTermination()
    return spark.read.schema(worker.RESULT).parquet(f"{root}/out")


@query
def session_aggregates_kept(spark, d):
    """Stored aggregates after a fifth of the photos came, a third went and a quarter of the objects came."""
    i, x, s = a.images(spark, d), a.detections(spark, d), a.sessions(spark, d)
    table = VersionedTable.create(sessions.session_aggregates(s, i.filter("id % 5 != 0"), x.filter("id % 4 != 0")), _place(spark, "aggregates"), ["id"], 16)
    change = F.when(F.col("id") % 3 != 0, 1).otherwise(-1)
    photos = i.filter("(id % 5 = 0) = (id % 3 != 0)").select("monitoring_session_id", "timestamp", change.alias("change"))
    maintenance.refresh_aggregates(table, photos, x.filter("id % 4 = 0").select("monitoring_session_id", F.lit(1).alias("change")), i.filter("id % 3 != 0"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return table.read().select("id", F.col("num_images").cast("long"), F.col("num_detected_objects").cast("long"), us("start_time"), us("end_time"))


@query
def job_totals(spark, d):
    """Three jobs at once, with a task for each photo; a photo's result is the number of its stored detections. Totals
    of tasks come from the running queries, results from the sink."""
    results.register(spark)
    root = _place(spark, "jobs")
    n = F.col("id")
    found = a.detections(spark, d).select(F.col("image_id").cast("string").alias("id"), F.col("image_id").cast("string").alias("source_image_id"))
    tasks = a.images(spark, d).select(n.cast("string").alias("id"), n.cast("string").alias("image_id"), F.when(n % 7 != 3, F.concat(F.lit("file://"), "path")).alias("image_url"), F.concat(F.lit("r"), n.cast("string")).alias("reply_subject"), (n % 3).alias("job"))
    tasks.write.partitionBy("job").parquet(f"{root}/tasks")
    jobs = {f"job_{k}": spark.readStream.schema(tasks.drop("job").schema).parquet(f"{root}/tasks/job={k}") for k in range(3)}
    done = worker.run_jobs(jobs, root, {k: lambda photos: found.join(photos, "id", "left_semi") for k in jobs})
    counted = spark.createDataFrame([(k, t["tasks"], t["unusable"]) for k, t in done.totals.items()], "job string, tasks long, unusable long")  # a row for each job
    parts = [results.results(spark, f"{root}/{k}/results", worker.RESULT).agg(F.sum("n_detections").alias("n_detections"), F.count("*").alias("results")).select(F.lit(k).alias("job"), "n_detections", "results") for k in jobs]
    return counted.join(reduce(DataFrame.unionByName, parts), "job")


@query
def queue_pull_by_many(spark, d):
    """Four pullers at once take 20 objects each out of one stored queue: the first 80, each once."""
    rows = _queued(spark, d).select("id", "bbox", "binary_label", "specific_label", "in_queue")
    table = VersionedTable.create(rows, _place(spark, "queue"), ["id"], 16)
    with ThreadPoolExecutor(4) as pullers:
        taken = list(pullers.map(lambda _: maintenance.pull(table, queues.QUEUES["unclassified_objects"], 20), range(4)))
    return reduce(DataFrame.unionByName, [t.select("id") for t in taken if t is not None])


@query
def detection_upsert_stored(spark, d):
    """`detection_upsert` on a stored table: buckets without a photo of the change stay as they are."""
    x = a.detections(spark, d).select("id", "image_id", "bbox", "area_pixels", "in_queue")
    table = VersionedTable.create(x, _place(spark, "detections"), ["image_id"], 16)
    maintenance.replace_detections(table, x.filter("id % 50 = 0").select((F.col("id") + 10_000_000).alias("id"), "image_id", "bbox"))
    return table.read().select("id", "image_id", "area_pixels", "in_queue")


@query
def retracked_incrementally(spark, d):
    """Tracks of all sessions; one in five had a late photo, was cleared and tracked anew in the stored tables. Detections
    are stored with the ids of their features, so what is rewritten has none."""
    x, i, s = _traps(spark, d)
    key, features = "monitoring_session_id", a.features(spark, d)
    x = x.select("id", "image_id", key, "binary_label", "bbox", "feature_id")
    rows = VersionedTable.create(tracking.retrack(x, tracking.track(x, i, s, a.WIDTH, a.HEIGHT, 1.75, features=features)), _place(spark, "detections"), [key], 16)
    photos = VersionedTable.create(i.select("id", key, "timestamp"), _place(spark, "images"), [key], 16)
    maintenance.late_photos(rows, s.filter("id % 5 = 0").select(F.col("id").alias("session")))
    maintenance.retrack(rows, photos, s, a.WIDTH, a.HEIGHT, threshold=1.75, features=features)
    t = rows.read().filter(F.col("binary_label") == "moth").select("id", *tracking.TRACK_COLUMNS)
    return t.withColumn("sequence_previous_cost", F.round("sequence_previous_cost", 6))


def _sessions_of_stream(spark, d, still_open):
    c = _stream(spark, d, "events").select(F.concat(F.lit("/traps/trap_"), F.col("user_id").cast("string")).alias("base_directory"), F.col("ts").alias("timestamp"))
    root = _place(spark, "sessions")
    stream_sessions.run(c, root, f"{root}/state").awaitTermination()
    return stream_sessions.sessions(spark, root, still_open).select("base_directory", "session_ordinal", "num_images")


@query
def stream_sessionize(spark, d):
    """Sessions of the events of each trap that were closed by the end of the stream."""
    return _sessions_of_stream(spark, d, False)


@query
def stream_sessionize_all(spark, d):
    """The same, and those that are still open then."""
    return _sessions_of_stream(spark, d, True)


@query
def export_roundtrip(spark, d):
    """Detections written as JSON and read again."""
    rows = a.detections(spark, d).select("id", "image_id", "bbox", "specific_label", "specific_label_score", "in_queue")
    root = _place(spark, "export")
    exports.export(rows, root, "json")
    return spark.read.schema(rows.schema).json(root).select("id", "image_id", geometry.area(F.col("bbox")).alias("area"), "specific_label", "specific_label_score", "in_queue")
