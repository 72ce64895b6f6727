"""The catalogue's queries in SQL, for DuckDB, over the driver's tables."""

from __future__ import annotations

_DET = """
e0 AS (SELECT event_id AS n, user_id, ts, event_type, value, props, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS off FROM events),
det0 AS (
  SELECT n AS id, user_id * 100000 + off AS image_id, user_id * 1000 + off // 7 AS monitoring_session_id, user_id,
    concat('/traps/trap_', user_id) AS base_directory, ts AS "timestamp", value,
    CASE WHEN n % 41 <> 0 THEN [CAST((n*37)%900 AS DOUBLE), CAST((n*53)%600 AS DOUBLE), CAST((n*37)%900 + 40 + (n*11)%200 AS DOUBLE), CAST((n*53)%600 + 40 + (n*7)%150 AS DOUBLE)] END AS bbox,
    concat('crop_', n, '.jpg') AS path,
    CASE WHEN n % 17 = 0 THEN NULL WHEN event_type = 'error' THEN 'nonmoth' ELSE 'moth' END AS binary_label,
    CASE WHEN n % 17 <> 0 THEN round(least(value / 50.0, 1.0), 6) END AS binary_label_score,
    CASE WHEN n % 17 <> 0 AND event_type <> 'error' AND n % 10 <> 0 THEN concat('species_', n % 25) END AS specific_label,
    CASE WHEN n % 17 <> 0 AND event_type <> 'error' AND n % 10 <> 0 THEN round(least(value / 100.0, 1.0), 6) END AS specific_label_score,
    CASE WHEN n % 31 <> 0 THEN n % 3 = 0 END AS in_queue, CASE WHEN n % 5 <> 0 THEN ts END AS last_processed, ts + to_seconds(n * 7919 % 100000) AS last_detected,
    CASE WHEN n % 7 <> 0 THEN n % 500 END AS feature_id,
    CASE WHEN n % 13 <> 0 THEN concat(user_id, '-SEQ-', n % 40) END AS sequence_id
  FROM e0),
det AS (
  SELECT *, CASE WHEN sequence_id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY sequence_id ORDER BY "timestamp", id) - 1 AS INTEGER) END AS sequence_frame,
    CAST((bbox[4] - bbox[2]) * (bbox[3] - bbox[1]) AS INTEGER) AS area_pixels
  FROM det0),
img AS (
  SELECT image_id AS id, min(user_id) AS user_id, min(monitoring_session_id) AS monitoring_session_id, min(base_directory) AS base_directory,
    concat('img_', image_id, '.jpg') AS path, min("timestamp") AS "timestamp", CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS filesize,
    CASE WHEN image_id % 4 <> 0 THEN max(last_processed) END AS last_processed, image_id % 3 = 0 AS in_queue
  FROM det GROUP BY image_id),
ses AS (SELECT monitoring_session_id AS id, min(base_directory) AS base_directory, CAST(min("timestamp") AS DATE) AS day FROM img GROUP BY monitoring_session_id),
cap AS (SELECT event_id AS id, concat('/traps/trap_', user_id) AS base_directory, concat('img_', event_id % 500, '.jpg') AS path, ts AS "timestamp" FROM events),
agg AS (
  SELECT s.*, coalesce(i.n, 0) AS num_images, coalesce(d.n, 0) AS num_detected_objects, i.a AS start_time, i.b AS end_time
  FROM ses s LEFT JOIN (SELECT monitoring_session_id m, count(*) n, min("timestamp") a, max("timestamp") b FROM img GROUP BY 1) i ON s.id = i.m
  LEFT JOIN (SELECT monitoring_session_id m, count(*) n FROM det GROUP BY 1) d ON s.id = d.m)
"""


def _with(body: str, more: str = "") -> str:
    return f"WITH {_DET}{',' + more if more else ''} {body}"


def _recursive(body: str, more: str) -> str:
    return f"WITH RECURSIVE {_DET},{more} {body}"


def _gap(wrapped: bool) -> str:
    seconds = """floor((epoch_us("timestamp") - epoch_us(lag("timestamp") OVER w)) / 1000000.0)"""
    if wrapped:
        seconds = f"({seconds} % 86400)"
    return f"""
g AS (SELECT *, {seconds} / 60.0 AS gap FROM cap WINDOW w AS (PARTITION BY base_directory ORDER BY "timestamp", id)),
o AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap >= 360 THEN 1 ELSE 0 END) OVER (PARTITION BY base_directory ORDER BY "timestamp", id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS session_ordinal FROM g),
p AS (SELECT id, base_directory, session_ordinal, CAST(CAST(min("timestamp") OVER (PARTITION BY base_directory, session_ordinal) AS DATE) AS VARCHAR) AS session_day FROM o)"""


_SCOPE = """
q AS (SELECT *, feature_id AS cnn_features FROM det),
s2 AS (SELECT * FROM q WHERE bbox IS NOT NULL AND id IN (SELECT max(id) FROM q WHERE bbox IS NOT NULL GROUP BY bbox)),
s3 AS (SELECT * FROM q WHERE binary_label = 'moth' AND id IN (SELECT max(id) FROM q WHERE binary_label = 'moth' GROUP BY bbox)),
s5 AS (SELECT * FROM q WHERE binary_label = 'moth' AND cnn_features IS NOT NULL AND id IN (SELECT max(id) FROM q WHERE binary_label = 'moth' AND cnn_features IS NOT NULL GROUP BY bbox)),
pulled AS (SELECT id FROM s3 WHERE in_queue IS TRUE AND specific_label IS NULL AND bbox IS NOT NULL ORDER BY id LIMIT 20)"""

_STATUS = """
SELECT *, CASE WHEN queued > 0 THEN 'Waiting' WHEN unprocessed > 0 THEN 'Idle' ELSE 'Done' END AS status FROM (
SELECT 'source_images' AS queue, count(*) FILTER (last_processed IS NULL) AS unprocessed, count(*) FILTER (in_queue IS TRUE) AS queued, count(*) FILTER (last_processed IS NOT NULL) AS done FROM img
UNION ALL SELECT 'detected_objects', count(*) FILTER (binary_label IS NULL), count(*) FILTER (in_queue IS TRUE AND binary_label IS NULL), count(*) FILTER (binary_label IS NOT NULL) FROM s2
UNION ALL SELECT 'unclassified_objects', count(*) FILTER (specific_label IS NULL), count(*) FILTER (in_queue IS TRUE AND specific_label IS NULL), count(*) FILTER (specific_label IS NOT NULL) FROM s3
UNION ALL SELECT 'objects_without_features', count(*) FILTER (cnn_features IS NULL), count(*) FILTER (in_queue IS TRUE AND cnn_features IS NULL), count(*) FILTER (cnn_features IS NOT NULL) FROM s3
UNION ALL SELECT 'untracked_objects', count(*) FILTER (sequence_id IS NULL), count(*) FILTER (in_queue IS TRUE AND sequence_id IS NULL), count(*) FILTER (sequence_id IS NOT NULL) FROM s5)"""

_DUP = """dup AS (SELECT *, count(*) OVER (PARTITION BY path) AS group_size, row_number() OVER (PARTITION BY path ORDER BY "timestamp" ASC NULLS LAST, id) AS place FROM cap)"""

_COST = """
feat AS (SELECT vec_id AS feature_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS f FROM embeddings),
fr AS (SELECT id AS image_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY "timestamp", id) - 1 AS frame_no FROM img),
m AS (SELECT d.id, d.bbox AS b, f.f, fr.user_id, fr.frame_no FROM det d JOIN feat f USING (feature_id) JOIN fr USING (image_id) WHERE d.binary_label = 'moth' AND d.bbox IS NOT NULL),
pr AS (SELECT x.id, y.id AS previous_id, x.b, y.b AS c, list_inner_product(x.f, y.f) / (sqrt(list_inner_product(x.f, x.f)) * sqrt(list_inner_product(y.f, y.f))) AS cosine FROM m x JOIN m y ON x.user_id = y.user_id AND x.frame_no = y.frame_no + 1),
pa AS (SELECT *, greatest(least(b[3], c[3]) - greatest(b[1], c[1]) + 1, 0) * greatest(least(b[4], c[4]) - greatest(b[2], c[2]) + 1, 0) AS shared, (b[3]-b[1]+1)*(b[4]-b[2]+1) AS sb, (c[3]-c[1]+1)*(c[4]-c[2]+1) AS sc FROM pr),
cost AS (SELECT id, previous_id, (1 - cosine) + (1 - round_even(shared / (sb + sc - shared) * 100, 0) / 100) + (1 - least(sb, sc) / greatest(sb, sc)) + sqrt(pow((b[1]+b[3])/2 - (c[1]+c[3])/2, 2) + pow((b[2]+b[4])/2 - (c[2]+c[4])/2, 2)) / 1443 AS cost FROM pa),
par AS (SELECT id, previous_id, c AS cost FROM (SELECT id, previous_id, round(cost, 9) AS c, row_number() OVER (PARTITION BY id ORDER BY round(cost, 9), previous_id) AS k FROM cost) WHERE k = 1 AND c <= 1.75)"""

#: The same, but for a photo's objects from its first one without features on.
_COST_IN_ORDER = _COST.replace("WHERE d.binary_label = 'moth' AND d.bbox IS NOT NULL)", "LEFT JOIN (SELECT image_id, min(id) AS bare FROM det LEFT JOIN feat USING (feature_id) WHERE binary_label = 'moth' AND f IS NULL GROUP BY 1) g USING (image_id) WHERE d.binary_label = 'moth' AND d.bbox IS NOT NULL AND (bare IS NULL OR d.id < bare))")

_TRACKS = "SELECT t.id, concat(strftime(d.day, '%Y%m%d'), '-SEQ-', t.root) AS sequence_id, CAST(t.frame AS INTEGER) AS sequence_frame, par.previous_id AS sequence_previous_id, round(par.cost, 6) AS sequence_previous_cost FROM tree t LEFT JOIN par ON t.id = par.id JOIN det x ON t.id = x.id JOIN (SELECT user_id, CAST(min(\"timestamp\") AS DATE) AS day FROM img GROUP BY 1) d ON x.user_id = d.user_id"
_TREE = ", tree AS (SELECT id, id AS root, 0 AS frame FROM det WHERE binary_label = 'moth' AND id NOT IN (SELECT id FROM par) UNION ALL SELECT par.id, tree.root, tree.frame + 1 FROM par JOIN tree ON par.previous_id = tree.id)"

_LABEL = "coalesce(specific_label, binary_label)"

SQL: dict[str, str] = {
    "occurrence_summary": _with(
        """SELECT t.monitoring_session_id, t.sequence_id, regexp_replace(t.sequence_id, '^[^-]*-', '') AS name, x.label, round(t.best, 6) AS best_score, t.n AS num_detections, t.b - t.a AS duration_us, x.ids AS example_ids
        FROM (SELECT monitoring_session_id, sequence_id, max(specific_label_score) best, count(*) n, epoch_us(min("timestamp")) a, epoch_us(max("timestamp")) b FROM det WHERE sequence_id IS NOT NULL GROUP BY 1, 2 HAVING max(specific_label_score) >= 0.2) t
        JOIN (SELECT monitoring_session_id, sequence_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY k) ids, max(specific_label) FILTER (k = 1) AS label FROM (SELECT *, row_number() OVER (PARTITION BY monitoring_session_id, sequence_id ORDER BY specific_label_score DESC NULLS LAST, id) k FROM det WHERE sequence_id IS NOT NULL) WHERE k <= 3 GROUP BY 1, 2) x
        ON t.monitoring_session_id = x.monitoring_session_id AND t.sequence_id = x.sequence_id"""
    ),
    "occurrences_limited": _with(
        """SELECT t.monitoring_session_id, t.sequence_id, t.n AS num_detections, x.specific_label AS label
        FROM (SELECT *, row_number() OVER (PARTITION BY monitoring_session_id ORDER BY sequence_id NULLS FIRST) place FROM (SELECT monitoring_session_id, sequence_id, count(*) n FROM det GROUP BY 1, 2 HAVING max(specific_label_score) >= -1)) t
        JOIN (SELECT *, row_number() OVER (PARTITION BY monitoring_session_id, sequence_id ORDER BY specific_label_score DESC NULLS LAST, id) k FROM det) x
        ON t.monitoring_session_id = x.monitoring_session_id AND t.sequence_id = x.sequence_id AND x.k = 1 WHERE place <= 3"""
    ),
    "deployment_summary": _with("SELECT regexp_replace(base_directory, '^.*/', '') AS name, base_directory, count(*) AS num_sessions, CAST(sum(num_images) AS BIGINT) AS num_images, CAST(sum(num_detected_objects) AS BIGINT) AS num_objects FROM agg GROUP BY 2"),
    "session_aggregates": _with("SELECT id, num_images, num_detected_objects, epoch_us(end_time) - epoch_us(start_time) AS duration_us, CAST(round_even(floor((epoch_us(end_time) - epoch_us(start_time)) / 1000000.0) / 60.0, 0) AS INTEGER) AS duration_minutes FROM agg"),
    "session_report": _with("SELECT id, base_directory AS deployment, CAST(day AS VARCHAR) AS date, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, strftime(end_time, '%Y-%m-%d %H:%M:%S') AS end_time, CAST(round_even(floor((epoch_us(end_time) - epoch_us(start_time)) / 1000000.0) / 60.0, 0) AS INTEGER) AS duration_minutes, num_images, num_detected_objects FROM agg"),
    "session_distincts": _with("SELECT monitoring_session_id, count(DISTINCT specific_label) FILTER (specific_label_score >= 0.3) AS num_species, count(DISTINCT sequence_id) AS num_occurrences FROM det GROUP BY 1"),
    "sessionize_gap": _with("SELECT * FROM p", _gap(False)),
    "stream_sessionize_all": _with("SELECT base_directory, session_ordinal, count(*) AS num_images FROM p GROUP BY 1, 2", _gap(False)),
    "sessionize_gap_wrapped": _with("SELECT * FROM p", _gap(True)),
    "sessionize_last_per_day": _with("SELECT id, base_directory, session_ordinal, session_day FROM (SELECT *, max(session_ordinal) OVER (PARTITION BY base_directory, session_day) AS z FROM p) WHERE z = session_ordinal", _gap(False)),
    "list_species": _with("SELECT specific_label, count(sequence_id) AS count FROM det WHERE specific_label_score >= 0.3 GROUP BY 1"),
    "species_counts": _with(f"SELECT {_LABEL} AS label, round(avg(specific_label_score), 6) AS mean_score, count(*) AS count, arg_min(path, id) AS path FROM det GROUP BY 1"),
    "species_max_area": _with(f"SELECT {_LABEL} AS label, count(*) AS count, max(area_pixels) AS max_area FROM det GROUP BY 1"),
    "unique_species": _with("SELECT coalesce(specific_label, binary_label, path) AS label, max(coalesce(specific_label_score, binary_label_score, 0)) AS score, count(*) AS count FROM det GROUP BY 1"),
    "classification_results": _with("SELECT id, CASE WHEN specific_label_score <> 0 AND specific_label_score >= 0.4 THEN specific_label ELSE binary_label END AS label, coalesce(specific_label_score, 0) AS score, path FROM det"),
    "classification_summary": _with("SELECT CASE WHEN specific_label_score <> 0 AND specific_label_score >= 0.4 THEN specific_label ELSE binary_label END AS label, count(*) AS count, round(avg(coalesce(specific_label_score, 0)), 6) AS mean_score FROM det GROUP BY 1"),
    "detections_filtered_page": _with("SELECT d.id, d.monitoring_session_id, CAST(s.day AS VARCHAR) AS day FROM det d JOIN ses s ON d.monitoring_session_id = s.id WHERE coalesce(specific_label_score, binary_label_score, 0) >= 0.5 ORDER BY d.id LIMIT 100 OFFSET 50"),
    "image_object_counts": _with("SELECT image_id, count(*) AS num_objects, count(*) FILTER (binary_label = 'moth') AS num_positive, count(*) FILTER (binary_label = 'moth' AND specific_label IS NOT NULL) AS num_classified, count(DISTINCT specific_label) FILTER (specific_label_score >= 0.3) AS num_species FROM det GROUP BY 1"),
    "completely_classified": _with("SELECT i.id, i.last_processed IS NOT NULL AND NOT coalesce(i.in_queue, false) AND coalesce(c.x, 0) = coalesce(c.y, 0) AS complete FROM img i LEFT JOIN (SELECT image_id, count(*) FILTER (binary_label = 'moth' AND specific_label IS NOT NULL) x, count(*) FILTER (binary_label = 'moth') y FROM det GROUP BY 1) c ON i.id = c.image_id"),
    "track_info": _with("""SELECT sequence_id, strftime(min("timestamp"), '%Y-%m-%d %H:%M:%S') AS start_time, CAST(round_even(floor((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 1000000.0) / 60.0, 0) AS INTEGER) AS minutes, max(sequence_frame) + 1 AS frames FROM det WHERE sequence_id IS NOT NULL GROUP BY 1"""),
    "tracks_collected": _with("SELECT monitoring_session_id, sequence_id, string_agg(concat(sequence_frame, ':', id), ' ' ORDER BY sequence_frame, id) AS frames FROM det WHERE sequence_id IS NOT NULL GROUP BY 1, 2"),
    "single_frame_tracks": _with("SELECT sequence_id, count(*) AS frames FROM det WHERE sequence_id IS NOT NULL GROUP BY 1 HAVING count(*) = 1"),
    "broken_tracks": "SELECT CAST(conv_id AS VARCHAR) AS sequence_id, turn + turn // 3 AS sequence_frame, e AS expected_frame FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM conversations) WHERE turn + turn // 3 <> e",
    "occurrences_by_label": _with("""SELECT sequence_id, specific_label, count(*) AS count, epoch_us(max("timestamp")) - epoch_us(min("timestamp")) AS span_us FROM det WHERE sequence_id IS NOT NULL AND specific_label IS NOT NULL GROUP BY 1, 2"""),
    "avg_detections_per_image": _with("SELECT (SELECT count(*) FROM det) AS num_detections, (SELECT count(*) FROM img) AS num_images, round((SELECT count(*) FROM det) / (SELECT count(*) FROM img), 6) AS average"),
    "orphan_detections": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')",
    "missing_tracks": _with("SELECT id, image_id FROM det WHERE binary_label = 'moth' AND sequence_id IS NULL"),
    "neighbour_images": _with("""SELECT i.id, (SELECT arg_max(j.id, j."timestamp") FROM img j WHERE j.monitoring_session_id = i.monitoring_session_id AND j."timestamp" < i."timestamp") AS previous_image, (SELECT arg_min(j.id, j."timestamp") FROM img j WHERE j.monitoring_session_id = i.monitoring_session_id AND j."timestamp" > i."timestamp") AS next_image FROM img i"""),
    "previous_frame_pairs": _with("""SELECT d.id, p.id AS previous_id FROM det d JOIN (SELECT id, lag(id) OVER (PARTITION BY monitoring_session_id ORDER BY "timestamp", id) AS before FROM img) i ON d.image_id = i.id JOIN det p ON p.image_id = i.before"""),
    "cyclic_neighbour": _with("""SELECT id, coalesce(lead(id) OVER w, first_value(id) OVER (PARTITION BY monitoring_session_id ORDER BY "timestamp", id)) AS next_id, coalesce(lag(id) OVER w, last_value(id) OVER (PARTITION BY monitoring_session_id ORDER BY "timestamp", id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_id FROM img WINDOW w AS (PARTITION BY monitoring_session_id ORDER BY "timestamp", id)"""),
    "best_sibling": _with("SELECT d.id, coalesce(b.id, d.id) AS best_id FROM det d LEFT JOIN (SELECT sequence_id, id FROM (SELECT *, row_number() OVER (PARTITION BY sequence_id ORDER BY specific_label_score DESC, id) k FROM det WHERE sequence_id IS NOT NULL AND specific_label_score IS NOT NULL) WHERE k = 1) b ON d.sequence_id = b.sequence_id"),
    "cover_photo": _with("SELECT monitoring_session_id, id AS image_id, path, filesize FROM (SELECT *, row_number() OVER (PARTITION BY monitoring_session_id ORDER BY filesize DESC, id) k FROM img) WHERE k = 1"),
    "mid_session_sample": _with("""SELECT monitoring_session_id, id, place FROM (SELECT *, row_number() OVER (PARTITION BY monitoring_session_id ORDER BY "timestamp", id) - 1 AS place, count(*) OVER (PARTITION BY monitoring_session_id) AS n FROM img) WHERE place >= n // 2 AND place < n // 2 + 2"""),
    "duplicate_groups": _with("SELECT id, path, group_size FROM dup WHERE group_size > 1", _DUP),
    "duplicate_retention": _with("SELECT id, path, place = 1 AS keep FROM dup WHERE group_size > 1", _DUP),
    "duplicate_retention_nulls_first": _with("""SELECT id, path, k = 1 AS keep FROM (SELECT id, path, count(*) OVER (PARTITION BY path) AS n, row_number() OVER (PARTITION BY path ORDER BY CASE WHEN id % 7 <> 0 THEN "timestamp" END NULLS FIRST, id) AS k FROM cap) WHERE n > 1"""),
    "duplicate_deletes": _with("SELECT id FROM dup WHERE group_size > 1 AND place > 1", _DUP),
    "duplicate_survivors": _with("SELECT id, path FROM dup WHERE place = 1", _DUP),
    "unique_bbox_latest": _with("""SELECT id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, bbox ORDER BY last_detected DESC, id DESC) k FROM det WHERE binary_label = 'moth') WHERE k = 1"""),
    "bbox_dedup_scope": _with("SELECT id FROM s2", _SCOPE),
    "queue_status": _with(_STATUS, _SCOPE),
    "queue_counts_global": _with(
        "SELECT 'images' AS queue, count(*) FILTER (in_queue) AS queued, count(*) FILTER (last_processed IS NULL) AS unprocessed FROM img UNION ALL SELECT 'unclassified_objects', count(*) FILTER (in_queue AND binary_label IS NULL), count(*) FILTER (binary_label IS NULL) FROM det UNION ALL SELECT 'unclassified_species', count(*) FILTER (in_queue AND specific_label IS NULL AND binary_label IS NOT NULL), count(*) FILTER (specific_label IS NULL AND binary_label IS NOT NULL) FROM det"
    ),
    "queue_clear_all": _with("SELECT id, CASE WHEN id IN (SELECT id FROM s2) OR id IN (SELECT id FROM s3) OR id IN (SELECT id FROM s5) THEN false ELSE in_queue END AS in_queue FROM q", _SCOPE),
    "queue_pull_pairs": _with(
        """SELECT t.id, coalesce(string_agg(CAST(p.id AS VARCHAR), ',' ORDER BY p.id), '') AS previous_ids FROM (SELECT id, image_id FROM s5 WHERE in_queue IS TRUE AND sequence_id IS NULL ORDER BY id LIMIT 20) t JOIN (SELECT id, lag(id) OVER (PARTITION BY monitoring_session_id ORDER BY "timestamp", id) AS before FROM img) i ON t.image_id = i.id LEFT JOIN q p ON p.image_id = i.before GROUP BY t.id""",
        _SCOPE,
    ),
    "queue_pull_n": _with("SELECT id FROM pulled", _SCOPE),
    "session_aggregates_kept": _with("SELECT s.id, coalesce(i.n, 0) AS num_images, coalesce(x.n, 0) AS num_detected_objects, i.a AS start_time, i.z AS end_time FROM ses s LEFT JOIN (SELECT monitoring_session_id, count(*) AS n, epoch_us(min(\"timestamp\")) AS a, epoch_us(max(\"timestamp\")) AS z FROM img WHERE id % 3 <> 0 GROUP BY 1) i ON s.id = i.monitoring_session_id LEFT JOIN (SELECT monitoring_session_id, count(*) AS n FROM det GROUP BY 1) x ON s.id = x.monitoring_session_id"),
    "job_totals": _with("SELECT concat('job_', i.id % 3) AS job, count(*) AS tasks, count(*) FILTER (i.id % 7 = 3) AS unusable, CAST(sum(CASE WHEN i.id % 7 = 3 THEN 0 ELSE coalesce(n, 0) END) AS BIGINT) AS n_detections, count(*) AS results FROM img i LEFT JOIN (SELECT image_id, count(*) AS n FROM det GROUP BY 1) d ON i.id = d.image_id GROUP BY 1"),
    "queue_pull_by_many": _with("SELECT id FROM s3 WHERE in_queue IS TRUE AND specific_label IS NULL AND bbox IS NOT NULL ORDER BY id LIMIT 80", _SCOPE),
    "queue_after_pull": _with("SELECT id, CASE WHEN id IN (SELECT id FROM pulled) THEN false ELSE in_queue END AS in_queue FROM q", _SCOPE),
    "queue_add_unprocessed": _with("SELECT id, CASE WHEN in_queue IS FALSE AND id IN (SELECT id FROM s5 WHERE sequence_id IS NULL) THEN true ELSE in_queue END AS in_queue FROM q", _SCOPE),
    "queue_clear": _with("SELECT id, CASE WHEN id IN (SELECT id FROM s3) THEN false ELSE in_queue END AS in_queue FROM q", _SCOPE),
    "queue_enqueue_session": _with("SELECT id, CASE WHEN monitoring_session_id = 1001 THEN true ELSE in_queue END AS in_queue FROM img"),
    "bbox_geometry": _with("""SELECT id, (bbox[4]-bbox[2])*(bbox[3]-bbox[1]) AS area, (bbox[1]+bbox[3])/2 AS cx, (bbox[2]+bbox[4])/2 AS cy, round(bbox[3]/1200, 4) AS "right", CAST(1443 AS BIGINT) AS diagonal, false AS empty FROM det WHERE bbox IS NOT NULL"""),
    "box_pairs": _with(
        """SELECT id, round_even(shared / (sb + sc - shared) * 100, 0) / 100 AS iou, round(least(sb, sc) / greatest(sb, sc), 6) AS ratio, round(sqrt(pow((b[1]+b[3])/2 - (c[1]+c[3])/2, 2) + pow((b[2]+b[4])/2 - (c[2]+c[4])/2, 2)) / 1443, 6) AS distance
        FROM (SELECT *, greatest(least(b[3], c[3]) - greatest(b[1], c[1]) + 1, 0) * greatest(least(b[4], c[4]) - greatest(b[2], c[2]) + 1, 0) AS shared, (b[3]-b[1]+1)*(b[4]-b[2]+1) AS sb, (c[3]-c[1]+1)*(c[4]-c[2]+1) AS sc FROM (SELECT x.id, x.bbox AS b, y.bbox AS c FROM det x JOIN det y ON y.id + 1 = x.id WHERE x.bbox IS NOT NULL AND y.bbox IS NOT NULL))"""
    ),
    "l1_normalize": "SELECT vec_id AS feature_id, round(f[1] / list_sum(f), 9) AS first, round(list_sum(list_transform(f, lambda x: x / list_sum(f))), 6) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS f FROM embeddings)",
    "softmax_argmax": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best, round(1 / list_sum(list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - list_max(embedding)))), 6) AS score FROM embeddings",
    "cosine_neighbours": "SELECT x.vec_id, round(list_inner_product(x.v, y.v) / (sqrt(list_inner_product(x.v, x.v)) * sqrt(list_inner_product(y.v, y.v))), 6) AS cosine FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) x JOIN (SELECT vec_id + 1 AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) y ON x.vec_id = y.vec_id",
    "tracking_costs": _with("SELECT id, previous_id, round(cost, 6) AS cost FROM cost", _COST),
    "tracking_parents": _with("SELECT id, previous_id, round(cost, 6) AS cost FROM par", _COST),
    "tracking_sequences": _recursive(_TRACKS, _COST + _TREE),
    "retracked_incrementally": _recursive(_TRACKS, _COST + _TREE),
    "stream_tracking": _recursive(_TRACKS, _COST + _TREE),
    "tracking_parents_in_order": _with("SELECT id, previous_id, round(cost, 6) AS cost FROM par", _COST_IN_ORDER),
    "tracking_sequences_in_order": _recursive(_TRACKS, _COST_IN_ORDER + _TREE),
    "stale_sessions": _with("SELECT DISTINCT monitoring_session_id FROM det WHERE sequence_id IS NULL AND binary_label = 'moth'"),
    "detection_upsert": _with("SELECT id, image_id, area_pixels, in_queue FROM det WHERE image_id NOT IN (SELECT image_id FROM det WHERE id % 50 = 0) UNION ALL SELECT id + 10000000, image_id, area_pixels, true FROM det WHERE id % 50 = 0"),
    "detection_upsert_stored": _with("SELECT id, image_id, area_pixels, in_queue FROM det WHERE image_id NOT IN (SELECT image_id FROM det WHERE id % 50 = 0) UNION ALL SELECT id + 10000000, image_id, area_pixels, true FROM det WHERE id % 50 = 0"),
    "classification_update": _with("SELECT id, CASE WHEN id % 4 = 0 THEN concat('new_', id % 3) ELSE specific_label END AS specific_label, CASE WHEN id % 8 = 0 THEN 0.99 ELSE specific_label_score END AS specific_label_score FROM det"),
    "session_upsert": _with("SELECT id, base_directory, CAST(day AS VARCHAR) AS day FROM ses"),
    "scan_upsert": _with(
        "SELECT id, base_directory, path FROM known UNION ALL SELECT s.id, s.base_directory, s.path FROM scan s WHERE s.base_directory IN (SELECT f.base_directory FROM (SELECT base_directory, count(*) n FROM scan GROUP BY 1) f LEFT JOIN (SELECT base_directory, count(*) n FROM known GROUP BY 1) k USING (base_directory) WHERE f.n > coalesce(k.n, 0)) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.base_directory = s.base_directory AND k.path = s.path)",
        " known AS (SELECT * FROM img WHERE id % 4 <> 0 OR user_id % 3 = 0), scan AS (SELECT * FROM img)",
    ),
    "delete_of_image": _with("SELECT id, image_id FROM det WHERE image_id <> 100003"),
    "slugify": "SELECT p_partkey, replace(trim(regexp_replace(lower(replace(t, ' ', '_')), '[^a-z0-9_]', '', 'g'), '_'), '__', '_') AS slug, replace(t, ' ', chr(10)) AS label FROM (SELECT p_partkey, concat(p_type, ' - ', p_brand, '  ', p_name) AS t FROM part)",
    "filename_timestamp": "SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 11 = 0 THEN strftime(ts, '%Y-%m-%d 00:00:00') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp FROM events",
    "url_basename": "SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') AS name FROM pages",
    "coordinates_dms": "SELECT c_custkey, CAST(d AS INTEGER) AS degrees, CAST(m AS INTEGER) AS minutes, round((v - d - m / 60) * 3600.0, 2) + 0.0 AS seconds, CASE WHEN d >= 1 THEN 'N' ELSE 'S' END AS side FROM (SELECT *, trunc((v - d) * 60) AS m FROM (SELECT c_custkey, v, trunc(v) AS d FROM (SELECT c_custkey, c_acctbal / 60.0 AS v FROM customer)))",
    "taxon_lookup": "SELECT p_partkey, label, coalesce(n_name, label) AS taxon_name FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE CAST(p_partkey % 40 AS VARCHAR) END AS label FROM part) LEFT JOIN nation ON TRY_CAST(label AS BIGINT) = n_nationkey",
    "json_props": "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "source_dedup_last_wins": "SELECT min(event_id) AS place, user_id AS id, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "positive_negative_split": _with("SELECT id, CASE binary_label WHEN 'moth' THEN 'positive' ELSE 'negative' END AS side FROM det WHERE binary_label IS NOT NULL"),
    "overlay_labels": _with("SELECT id, CASE WHEN binary_label = 'nonmoth' THEN NULL WHEN specific_label IS NOT NULL AND specific_label_score >= 0.4 THEN concat(specific_label, ' (', CAST(round_even(specific_label_score * 100, 0) AS INTEGER), '%)') ELSE '' END AS overlay FROM det"),
    "reported_labels": _with("SELECT id, coalesce(specific_label, binary_label) AS label, CASE WHEN specific_label IS NOT NULL THEN specific_label_score ELSE binary_label_score END AS score FROM det"),
    "absolute_paths": _with("SELECT id, CASE WHEN id % 3 = 2 THEN NULL ELSE concat(base_directory, '/', path) END AS path FROM img"),
    "labels_threshold_split": "SELECT quality, count(*) AS count, count(*) FILTER (coalesce(toxic, 0) >= 1) AS marked, max(n_chars) AS longest FROM labels JOIN documents USING (doc_id) GROUP BY quality",
    "frame_counter": _with("SELECT id, concat(sequence_frame + 1, ' of ', max(sequence_frame) OVER (PARTITION BY sequence_id) + 1) AS counter FROM det WHERE sequence_id IS NOT NULL"),
    "objects_for_species": _with("SELECT id, monitoring_session_id FROM det WHERE specific_label = 'species_3' AND monitoring_session_id = 1001 UNION ALL SELECT id, monitoring_session_id FROM det WHERE specific_label = 'species_4'"),
    "sessions_by_day": _with("SELECT id, num_images, num_detected_objects FROM agg WHERE day IN (DATE '2024-01-01', DATE '2024-01-08')"),
    "timestamped_folders": "SELECT DISTINCT strftime(ts, '%Y_%m_%d') AS name, strftime(ts, '%Y-%m-%d') AS day FROM events",
    "category_maps": "SELECT n_nationkey, concat(n_name, '|other') AS labels, 'other' AS last FROM nation",
    "decoded_payloads": "SELECT doc_id, md5(text) AS name FROM documents",
    "batch_shapes": "SELECT event_id // 8 AS batch, count(DISTINCT (event_id % 3) * 10 + (event_id // 16) % 2) AS shapes FROM events GROUP BY 1",
    "time_labels": "SELECT event_id, concat(h, CASE WHEN h = 1 THEN ' hour' ELSE ' hours' END) AS label, printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) AS clock FROM (SELECT event_id, event_id * 977 % 200000 AS s, CAST(round_even((event_id * 977 % 200000) % 86400 / 3600.0, 0) AS INTEGER) AS h FROM events)",
    "crop_names": _with("SELECT id, concat(replace(path, '.jpg', 'jpg'), '-', CAST(bbox[1] AS INTEGER), '_', CAST(bbox[2] AS INTEGER), '_', CAST(bbox[3] AS INTEGER), '_', CAST(bbox[4] AS INTEGER), '-20240101') AS name FROM det WHERE bbox IS NOT NULL"),
    "capture_details": _with("SELECT i.id, i.path, i.filesize, CAST(s.day AS VARCHAR) AS event, coalesce(x.o, '') AS objects FROM img i JOIN ses s ON i.monitoring_session_id = s.id LEFT JOIN (SELECT image_id, string_agg(concat_ws(':', id, specific_label, area_pixels), ',' ORDER BY id) AS o FROM det GROUP BY 1) x ON i.id = x.image_id"),
    "detection_report": _with(
        """SELECT d.id, regexp_replace(s.base_directory, '^.*/', '') AS deployment, CAST(s.day AS VARCHAR) AS session, s.id AS session_id, d.sequence_id AS sequence, d.sequence_frame, concat(i.base_directory, '/', i.path) AS source_image_path, d.path AS cropped_image_path, strftime(i."timestamp", '%Y-%m-%dT%H:%M:%S') AS timestamp, (d.bbox[1] + d.bbox[3]) / 2 AS center_x, d.area_pixels, coalesce(d.specific_label, d.binary_label) AS label, CASE WHEN d.specific_label IS NOT NULL THEN d.specific_label_score ELSE d.binary_label_score END AS score, d.in_queue
        FROM det d JOIN img i ON d.image_id = i.id JOIN ses s ON d.monitoring_session_id = s.id"""
    ),
    "sessions_page_by_day": _with("SELECT id, CAST(day AS VARCHAR) AS day FROM agg ORDER BY agg.day NULLS LAST, id LIMIT 20 OFFSET 20"),
    "detection_list": _with("SELECT id, image_id, path AS cropped_image_path, array_to_string(list_transform(bbox, lambda x: CAST(CAST(x AS DOUBLE) AS VARCHAR)), ',') AS bbox, area_pixels, strftime(last_detected, '%Y-%m-%d %H:%M:%S') AS last_detected, specific_label AS label, specific_label_score AS score, in_queue FROM det"),
    "sessions_in_order": _with("SELECT id, CAST(day AS VARCHAR) AS day, row_number() OVER (ORDER BY start_time, id) AS place FROM agg WHERE base_directory = '/traps/trap_7'"),
    "sessions_known": _with("SELECT count(*) AS count FROM ses WHERE base_directory = '/traps/trap_7'"),
    "captures_page": _with("""SELECT id, path FROM img WHERE user_id = 7 ORDER BY "timestamp", id LIMIT 20 OFFSET 5"""),
    "missing_source_data": _with("SELECT id FROM det WHERE id % 2 <> 0 OR id % 3 = 0 OR id % 5 = 0 UNION ALL SELECT -id FROM img WHERE id % 4 = 0 OR id % 6 = 0"),
    "batch_previous": _with("""SELECT id, lag(id) OVER (PARTITION BY id % 97 ORDER BY "timestamp", id) AS previous_image FROM img"""),
    "box_of_json": _with("SELECT id, (bbox[4]-bbox[2])*(bbox[3]-bbox[1]) AS area FROM det"),
    "batch_plan": "SELECT user_id, CAST(ceil(count(*) / 8.0) AS BIGINT) AS batches, round(sum(value) / count(*), 6) AS per_item FROM events GROUP BY 1",
    "classification_examples": _with("SELECT CASE WHEN specific_label_score <> 0 AND specific_label_score >= 0.4 THEN specific_label ELSE binary_label END AS label, least(count(*), 3) AS examples, true AS known FROM det GROUP BY 1"),
    "schema_downgrade": _with("SELECT id, image_id, path, specific_label, CAST(12 AS BIGINT) AS width FROM det"),
    "stream_sessionize": _with(
        """SELECT base_directory, session_ordinal, n AS num_images FROM (SELECT base_directory, session_ordinal, count(*) AS n, max(epoch_ms("timestamp")) AS last, max(session_ordinal) OVER (PARTITION BY base_directory) AS final FROM o GROUP BY 1, 2)
        WHERE session_ordinal < final OR last + 360 * 60000 < (SELECT max(epoch_ms("timestamp")) - 3600000 FROM cap)""",
        _gap(False),
    ),
    "queue_fill_sample": _with("SELECT count(*) AS images, greatest(count(*) FILTER (id % 50 = 0), least(400, count(*) FILTER (id % 50 = 0 OR last_processed IS NULL))) AS queued, CAST(0 AS BIGINT) AS wrong FROM img"),
    "mark_processed": _with("SELECT id, CASE WHEN id % 3 = 0 THEN '2024-06-01 00:00:00' ELSE strftime(last_processed, '%Y-%m-%d %H:%M:%S') END AS last_processed FROM img"),
    "backfill_from_images": _with("""SELECT d.id, strftime(CASE WHEN d.id % 2 = 0 THEN d."timestamp" ELSE i."timestamp" END, '%Y-%m-%d %H:%M:%S') AS "timestamp", 1200 AS source_image_width, CASE WHEN d.id % 3 = 0 THEN 5 ELSE 800 END AS source_image_height, i.before AS source_image_previous_frame FROM det d JOIN (SELECT *, lag(id) OVER (PARTITION BY monitoring_session_id ORDER BY "timestamp", id) AS before FROM img) i ON d.image_id = i.id"""),
    "retracked": _with("SELECT id, CASE WHEN id % 6 = 0 THEN 'new' ELSE sequence_id END AS sequence_id, CASE WHEN id % 6 = 0 THEN 0 ELSE sequence_frame END AS sequence_frame, CASE WHEN id % 6 = 0 THEN image_id END AS sequence_previous_id, CASE WHEN id % 6 = 0 THEN 0.5 END AS sequence_previous_cost FROM det"),
    "export_roundtrip": _with("SELECT id, image_id, (bbox[4]-bbox[2])*(bbox[3]-bbox[1]) AS area, specific_label, specific_label_score, in_queue FROM det"),
}
