"""Further queries over the driver's tables: lookups, gates, composites, bridges and operators with state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.functions import boxes, geometry, text, vectors
from velograph.operators import aggregates, dedup, filters, link, report, retrieval, smooth, tracker, tracks
from velograph.plans.driver_tables import FRAGMENTS, HEIGHT, LINE, OBSERVATIONS, WIDTH, ZONE, edge_sql, fragments, observations, polygon_sql, read
from velograph.plans.queries import _DUPLICATES, _RECORDS, ORDERED, _duplicates, _records, fx, fy, r6
from velograph.plans.registry import oracle_sql, query
from velograph.sources.readers import with_current_keys
from velograph.streaming.counting import run_once, track_states


def box() -> Column:
    return F.col("bbox")


def corners(b: Column) -> list[Column]:
    return [r6(b[c]).alias(c) for c in ("x1", "y1", "x2", "y2")]


@query("""WITH r AS (SELECT p_partkey AS record_id, p_partkey % 50 AS image, p_size % 5 AS req FROM part),
a AS (SELECT * FROM r WHERE record_id NOT IN (SELECT p_partkey - 1 FROM part WHERE p_partkey % 7 = 0))
SELECT c_custkey AS query_id, record_id FROM customer JOIN a ON c_custkey % 50 = image AND c_custkey % 5 = req""")
def exact_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = lambda c: F.sha2(c.cast("string"), 256)
    key, size = F.col("p_partkey"), F.col("p_size")
    records = read(spark, sf_dir, "part").select(key.alias("record_id"), digest(key % 50).alias("image_sha256"), digest(size % 5).alias("request_hash"), F.when(key % 7 == 0, key - 1).alias("supersedes_record_id"))
    own = F.col("c_custkey")
    queries = read(spark, sf_dir, "customer").select(own.alias("query_id"), digest(own % 50).alias("image_sha256"), digest(own % 5).alias("request_hash"))
    return retrieval.exact_matches(queries, records).select("query_id", "record_id")


_NEAR = "vec_id % 60 * 4398046511104 + vec_id % 9 * 1048576 + vec_id % 5"


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.lit("c").alias("contract"), "vec_id", F.col("embedding").cast("array<double>").alias("embedding"), "label", F.expr(_NEAR).alias("phash"))


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, {_NEAR} AS phash FROM embeddings),
p AS (SELECT a.vec_id AS query_id, b.vec_id AS record_id, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS hamming, greatest(0, list_cosine_distance(a.v, b.v)) AS d FROM e a JOIN e b ON a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0 AND bit_count(xor(a.phash, b.phash)) <= 2)
SELECT query_id, record_id, hamming, round(d, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, hamming, record_id) AS place FROM p WHERE d <= 0.95::DOUBLE""")
def approximate_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _hashed(spark, sf_dir)
    q = e.where("vec_id % 10 = 0").select("contract", F.col("vec_id").alias("query_id"), "phash", "embedding")
    r = e.where("vec_id % 10 <> 0").select("contract", F.col("vec_id").alias("record_id"), "phash", "embedding")
    found = retrieval.neighbours(q, r, bits=2, threshold=0.95, keys=["contract"])
    w = retrieval.nearest_first()
    return found.select("query_id", "record_id", "hamming", r6("distance").alias("distance"), F.row_number().over(w).alias("place"))


@query(f"""WITH e AS (SELECT vec_id, {_NEAR} AS phash FROM embeddings)
SELECT a.vec_id AS query_id, b.vec_id AS record_id, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS hamming FROM e a JOIN e b ON a.vec_id % 10 = 0 AND b.vec_id % 10 <> 0 AND bit_count(xor(a.phash, b.phash)) <= 5""")
def wider_image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _hashed(spark, sf_dir).select("contract", "vec_id", "phash")
    return retrieval.near_hashes(e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id"), e.where("vec_id % 10 <> 0").withColumnRenamed("vec_id", "record_id"), 5, ["contract"]).select("query_id", "record_id", "hamming")


@query(f"""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, {_NEAR} AS phash FROM embeddings),
p AS (SELECT greatest(0, list_cosine_distance(a.v, b.v)) AS d, a.label = b.label AS same FROM e a JOIN e b ON a.vec_id < b.vec_id AND bit_count(xor(a.phash, b.phash)) <= 2),
s AS (SELECT count(*) FILTER (WHERE same) AS same_pairs, count(*) FILTER (WHERE NOT same) AS conflict_pairs, max(d) FILTER (WHERE same) AS max_same, min(d) FILTER (WHERE NOT same) AS min_conflict FROM p)
SELECT same_pairs, conflict_pairs, round(max_same, 6) AS max_same, round(min_conflict, 6) AS min_conflict FROM s""")
def calibration_of_near_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hashed(spark, sf_dir).withColumnRenamed("vec_id", "ord")
    c = retrieval.calibration(rows, F.col("label"), keys=["contract"], bits=2)
    return c.select("same_pairs", "conflict_pairs", r6("max_same").alias("max_same"), r6("min_conflict").alias("min_conflict"))


@query("""WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS n FROM embeddings WHERE vec_id % 20 <> 0)
SELECT q.vec_id AS query_id, round(max(list_cosine_similarity(q.embedding::DOUBLE[], v.v)), 6) AS cosine FROM embeddings q LEFT JOIN v ON v.label = q.label AND v.n <= 16 WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id""")
def appearance_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings").select(F.lit("r").alias("run_id"), F.col("label").alias("track_id"), "vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    known = e.where("vec_id % 20 <> 0").withColumnRenamed("vec_id", "frame_index")
    found = tracker.best_similarity(known, e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"))
    return found.select("query_id", r6("cosine").alias("cosine"))


@query(f"""WITH {OBSERVATIONS} SELECT class_name, count(DISTINCT vehicle_index) AS vehicles FROM obs GROUP BY class_name""")
def vehicles_of_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.distinct_vehicles(observations(spark, sf_dir), "class_name")


@query(f"""WITH {OBSERVATIONS} SELECT pos, CASE WHEN pos % 2 = 0 THEN class_name WHEN pos % 3 = 0 THEN 'car' WHEN pos % 3 = 1 THEN 'bus' ELSE '' END AS name FROM obs""")
def filled_class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumns({"class_id": (F.col("pos") % 3).cast("int"), "class_name": F.when(F.col("pos") % 2 == 0, F.col("class_name"))})
    return filters.class_names(rows, {0: "car", 1: "bus"}).select("pos", F.col("class_name").alias("name"))


@query(f"""WITH {OBSERVATIONS} SELECT pos, CASE WHEN pos % 5 = 0 THEN 0.0::DOUBLE ELSE confidence END AS confidence, CASE WHEN pos % 7 = 0 THEN -1 ELSE track_id END AS track_id FROM obs""")
def defaulted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumns({"confidence": F.when(F.col("pos") % 5 != 0, F.col("confidence")), "track_id": F.when(F.col("pos") % 7 != 0, F.col("track_id"))})
    return filters.with_defaults(rows).select("pos", "confidence", "track_id")


@query(f"""WITH {OBSERVATIONS},
p AS (SELECT pos, x1, y1, x2, y2, least(greatest(trunc(x1 - (w * 0.05::DOUBLE + 2)), 0), 600) + 0 AS a, least(greatest(trunc(y1 - (h * 0.05::DOUBLE + 2)), 0), 400) + 0 AS b, least(greatest(trunc(x2 + (w * 0.05::DOUBLE + 2)), 0), 600) + 0 AS c, least(greatest(trunc(y2 + (h * 0.05::DOUBLE + 2)), 0), 400) + 0 AS d FROM feet)
SELECT pos, CASE WHEN c > a AND d > b THEN a ELSE x1 END AS x1, CASE WHEN c > a AND d > b THEN b ELSE y1 END AS y1, CASE WHEN c > a AND d > b THEN c ELSE x2 END AS x2, CASE WHEN c > a AND d > b THEN d ELSE y2 END AS y2 FROM p""")
def padded_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("pos", *corners(boxes.padded(box(), 600, 400)))


@query(f"""WITH {OBSERVATIONS} SELECT pos, x1 + 60 AS x1, y1 + 60 AS y1, x2 + 60 AS x2, y2 + 60 AS y2,
(400 >= x1 AND 300 >= y1 AND 400 < x2 AND 300 < y2) AS half_open, (400 >= x1 AND 300 >= y1 AND 400 <= x2 AND 300 <= y2) AS closed FROM obs""")
def offset_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.lit(400.0), F.lit(300.0)
    return observations(spark, sf_dir).select("pos", *corners(geometry.offset(box(), ZONE)), boxes.contains(box(), x, y, half_open=True).alias("half_open"), boxes.contains(box(), x, y).alias("closed"))


@query(f"""WITH {OBSERVATIONS} SELECT pos, floor(x1) <= 0 OR floor(y1) <= 0 OR ceil(x2) >= {WIDTH - 1} OR ceil(y2) >= {HEIGHT - 1} OR floor(x1) <= 60 OR floor(y1) <= 60 OR ceil(x2) >= 759 OR ceil(y2) >= 559 OR {edge_sql()} AS edge FROM obs""")
def edge_composites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations(spark, sf_dir).select("pos", filters.edge_flag(box(), WIDTH, HEIGHT, ZONE).alias("edge"))


_PLANE = np.array([[1.0, 0.1, 3.0], [0.05, 1.2, 1.0], [0.0005, 0.001, 1.0]])


@query(f"""WITH {OBSERVATIONS},
w AS (SELECT track_id, pos, frame_index, (fx + fy * 0.1::DOUBLE + 3) / (fx * 0.0005::DOUBLE + fy * 0.001::DOUBLE + 1) AS u, (fx * 0.05::DOUBLE + fy * 1.2::DOUBLE + 1) / (fx * 0.0005::DOUBLE + fy * 0.001::DOUBLE + 1) AS v FROM feet),
l AS (SELECT pos, u, v, lag(u) OVER ({ORDERED}) AS pu, lag(v) OVER ({ORDERED}) AS pv FROM w)
SELECT pos, round(u, 6) AS u, round(v, 6) AS v, CASE WHEN pu IS NULL THEN NULL ELSE round(sqrt((u - pu) ** 2 + (v - pv) ** 2), 6) END AS moved FROM l""")
def world_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("world", geometry.to_world(fx(), fy(), _PLANE))
    rows = rows.withColumn("before", F.lag("world").over(tracks.along()))
    away = geometry.world_distance(F.col("before"), F.col("world"))
    return rows.select("pos", r6("world.x").alias("u"), r6("world.y").alias("v"), r6(F.when(F.col("before").isNotNull(), away)).alias("moved"))


@query("""WITH s AS (SELECT p_partkey, 100.0::DOUBLE + p_partkey % 300 AS sw, 50.0::DOUBLE + p_size * 7 AS sh FROM part),
f AS (SELECT *, least(320 / sw, 240 / sh) AS k FROM s),
w AS (SELECT *, greatest(round_even(sw * k, 0), 1) AS w, greatest(round_even(sh * k, 0), 1) AS h FROM f),
c AS (SELECT *, 640 + floor((320 - w) / 2) AS x, 240 + floor((240 - h) / 2) AS y FROM w),
o AS (SELECT *, least(greatest((700 - x) * sw / w, 0), sw) AS a, least(greatest((300 - y) * sh / h, 0), sh) AS b, least(greatest((820 - x) * sw / w, 0), sw) AS c, least(greatest((400 - y) * sh / h, 0), sh) AS d FROM c)
SELECT p_partkey, x, y, x + w AS x2, y + h AS y2, CASE WHEN c > a AND d > b THEN round(a, 6) END AS found_x1, CASE WHEN c > a AND d > b THEN round(d, 6) END AS found_y2 FROM o""")
def composite_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lits = lambda *v: boxes.box(*[F.lit(float(x)) for x in v])
    sw, sh = F.lit(100.0) + F.col("p_partkey") % 300, F.lit(50.0) + F.col("p_size") * 7
    rows = read(spark, sf_dir, "part").withColumn("placed", boxes.fitted_into(sw, sh, lits(640, 240, 960, 480)))
    found = boxes.out_of_cell(lits(700, 300, 820, 400), F.col("placed"), sw, sh)
    return rows.select("p_partkey", F.col("placed.x1").alias("x"), F.col("placed.y1").alias("y"), F.col("placed.x2").alias("x2"), F.col("placed.y2").alias("y2"), r6(found["x1"]).alias("found_x1"), r6(found["y2"]).alias("found_y2"))


@query(f"""WITH {OBSERVATIONS}, {FRAGMENTS},
n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_index DESC, pos DESC) AS back, row_number() OVER ({ORDERED}) AS forth FROM frag),
p AS (SELECT a.track_id AS a_track_id, b.track_id AS b_track_id, a.frame_index AS af, b.frame_index AS bf, a.t AS ta, b.t AS tb, a.x1 AS a1, b.x1 AS b1, a.y2 AS a2, b.y2 AS b2, a.vehicle_index FROM n a JOIN n b ON a.back = 1 AND b.forth = 1 AND b.t > a.t AND b.t <= a.t + 2 AND a.track_id <> b.track_id AND a.vehicle_index IS NOT NULL AND b.vehicle_index IS NOT NULL),
fr AS (SELECT frame_index, min(t) AS t FROM frag GROUP BY frame_index),
s AS (SELECT p.*, fr.frame_index, fr.t, row_number() OVER (PARTITION BY a_track_id, fr.frame_index ORDER BY af, bf, b_track_id) AS k FROM p JOIN fr ON fr.frame_index > af AND fr.frame_index <= bf)
SELECT a_track_id AS track_id, frame_index, vehicle_index, round(a1 + (b1 - a1) * CASE WHEN tb > ta THEN least(greatest((t - ta) / (tb - ta), 0), 1) ELSE 1 END, 6) AS x1, round(a2 + (b2 - a2) * CASE WHEN tb > ta THEN least(greatest((t - ta) / (tb - ta), 0), 1) ELSE 1 END, 6) AS y2
FROM s WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM frag f WHERE f.track_id = s.a_track_id AND f.frame_index = s.frame_index)""")
def bridged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs bridge here, whether their looks pass or not, so that there are some at every size."""
    rows = fragments(observations(spark, sf_dir))
    frames = rows.groupBy("run_id", "frame_index").agg(F.min("t").alias("t"))
    made = dedup.bridges(rows, _duplicates(spark, sf_dir).withColumn("passes", F.lit(True)), frames)
    return made.select("track_id", "frame_index", "vehicle_index", r6("bbox.x1").alias("x1"), r6("bbox.y2").alias("y2"))


@query(f"""WITH {_RECORDS},
n AS (SELECT *, lead(position) OVER w AS np FROM rec WINDOW w AS ({ORDERED})),
g AS (SELECT track_id, unnest(range(position + 1, np)) AS position FROM n WHERE np - position - 1 BETWEEN 1 AND 25),
u AS (SELECT track_id, position FROM rec UNION ALL SELECT track_id, position FROM g)
SELECT track_id, count(*) AS n, CAST(sum(position) AS BIGINT) AS positions FROM u GROUP BY track_id""")
def smoothed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, frames = _records(spark, sf_dir)
    made = smooth.smoothed(rows.drop("position"), frames.drop("position"), observed=False, bridged=True, most=25)
    return made.groupBy("track_id").agg(F.count("*").alias("n"), F.sum("position").alias("positions"))


@query(f"""WITH {OBSERVATIONS}, s AS (SELECT track_id, min(frame_index) AS first_frame FROM obs GROUP BY track_id)
SELECT track_id, row_number() OVER (ORDER BY first_frame, track_id) AS place FROM s""")
def places_of_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link.order_of_tracks(tracks.track_metrics(observations(spark, sf_dir))).select("track_id", "place")


@query("""WITH l AS (SELECT p_partkey AS track_id, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 97 END AS vehicle_index, CASE WHEN p_size % 4 <> 0 THEN p_size % 4 END AS api FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY coalesce('v' || vehicle_index, 't' || track_id) ORDER BY coalesce(api, 0), track_id) AS n FROM l)
SELECT track_id, row_number() OVER (ORDER BY vehicle_index IS NULL, vehicle_index, coalesce(api, 0), track_id) AS place FROM f WHERE n = 1""")
def report_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, api = F.col("p_partkey"), F.col("p_size") % 4
    labels = read(spark, sf_dir, "part").select(F.lit("r").alias("run_id"), key.alias("track_id"), F.when(key % 7 != 0, key % 97).alias("vehicle_index"), F.when(api != 0, api).alias("api_classification_index"))
    return report.report_rows(labels).select("track_id", "place")


@query(f"""WITH {OBSERVATIONS} SELECT DISTINCT vehicle_index FROM obs WHERE vehicle_index IS NOT NULL AND vehicle_index NOT IN (SELECT p_partkey % 40 FROM part WHERE p_partkey % 3 = 0)""")
def unclassified_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.lit("r").alias("run_id"), (F.col("p_partkey") % 40).alias("vehicle_index"))
    return report.unclassified(observations(spark, sf_dir), labels).select("vehicle_index")


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '#47C8FF' WHEN 1 THEN '#39FF31' END AS colour, CASE WHEN p_size % 2 = 0 THEN '🇩🇪|' || p_brand || '|🇫🇷|🇺🇸' ELSE p_brand || '|🇯🇵' END AS parts FROM part""")
def flags_and_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("p_size") % 4 == 0, "BEV").when(F.col("p_size") % 4 == 1, "MIXED").when(F.col("p_size") % 4 == 2, "ICE")
    words = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("🇩🇪"), "p_brand", F.lit("🇫🇷🇺🇸"))).otherwise(F.concat("p_brand", F.lit("🇯🇵")))
    return read(spark, sf_dir, "part").select("p_partkey", text.powertrain_colour(kind).alias("colour"), F.array_join(text.split_flags(words), "|").alias("parts"))


@query("""SELECT event_id, strftime(ts, '%Y%m%d-%H%M%SZ') AS stamp, '{"mode":"fast","sides":2,"tags":true,"image":"' || event_type || '-' || user_id || '.jpg"}' AS body FROM events""")
def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    image = F.concat("event_type", F.lit("-"), F.col("user_id").cast("string"), F.lit(".jpg"))
    return read(spark, sf_dir, "events").select("event_id", text.run_stamp(F.col("ts").cast("timestamp_ntz")).alias("stamp"), report.request({"tags": True, "mode": "fast", "sides": 2}, image).alias("body"))


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'api_confirmed' END AS source, CASE WHEN p_size % 5 = 0 THEN p_type ELSE 'external_api' END AS method FROM part""")
def provenance_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.struct(F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("evidence_source"), F.when(F.col("p_size") % 5 == 0, F.col("p_type")).alias("resolution_method"))
    made = retrieval.with_provenance(label)
    return read(spark, sf_dir, "part").select("p_partkey", made["evidence_source"].alias("source"), made["resolution_method"].alias("method"))


@query("""WITH w AS (SELECT p_partkey, unnest([p_partkey % 90, p_partkey % 70 + 100, p_partkey % 30 + 200]) AS f, unnest([0, 1, 2]) AS place FROM part),
k AS (SELECT s_suppkey * 3 AS f FROM supplier)
SELECT p_partkey, arg_min(CAST(f AS VARCHAR) || '.jpg', place) AS path FROM w WHERE f IN (SELECT f FROM k) GROUP BY p_partkey""")
def first_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda c: F.concat(c.cast("string"), F.lit(".jpg"))
    key = F.col("p_partkey")
    wanted = read(spark, sf_dir, "part").select("p_partkey", F.array(name(key % 90), name(key % 70 + 100), name(key % 30 + 200)).alias("paths"))
    return retrieval.first_image(wanted, read(spark, sf_dir, "supplier").select(name(F.col("s_suppkey") * 3).alias("path")), "p_partkey")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size + 1 END AS min_box_width_px, CASE WHEN p_size % 2 = 0 THEN p_size + 1 END AS min_box_height_px, p_size + 2 AS max_box_width_px FROM part""")
def current_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    old = read(spark, sf_dir, "part").select("p_partkey", F.when(size % 2 == 0, size).alias("min_box_width_px"), (size + 1).alias("min_box_height_px"), (size + 2).alias("max_box_height_px"))
    return with_current_keys(old).drop("max_box_height_px")


_DIAGNOSTICS = f"""{OBSERVATIONS},
s AS (SELECT track_id, count(*) AS n, max(w) AS mw, max(h) AS mh, count(*) FILTER (WHERE confidence >= 0.97::DOUBLE) = 0 AS bare FROM feet GROUP BY track_id),
g AS (SELECT *, t - lag(t) OVER w AS gap, sqrt((fx - lag(fx) OVER w) ** 2 + (fy - lag(fy) OVER w) ** 2) AS dist, floor(x1) <= 15 OR floor(y1) <= 15 OR ceil(x2) >= {WIDTH} - 16 OR ceil(y2) >= {HEIGHT} - 16 AS edge FROM feet WINDOW w AS ({ORDERED})),
m AS (SELECT *, coalesce(bool_or(gap > 30 AND NOT (gap <= 60 AND dist <= least(400, gap * 10))) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING), false) AS gone FROM g)"""


@query(f"""WITH {_DIAGNOSTICS}
SELECT (SELECT count(DISTINCT frame_index) FROM obs) AS total_sampled_frames, (SELECT count(*) FROM obs) AS detections_passed_to_tracker, (SELECT count(*) FROM obs WHERE pos % 9 <> 0) AS tracker_outputs,
  (SELECT count(*) FROM s WHERE n < 60) AS tracks_discarded_min_track_frames, (SELECT count(*) FROM s WHERE bare) AS tracks_without_crop_candidates, (SELECT count(*) FROM s WHERE bare AND mw < 255) AS tracks_without_crop_due_to_width,
  (SELECT count(*) FROM s WHERE bare AND mh < 150) AS tracks_without_crop_due_to_height, (SELECT count(*) FROM s WHERE bare AND n < 60) AS tracks_without_crop_due_to_short_lifetime,
  (SELECT count(*) FROM m WHERE gone) AS stale_reassociation_observations_suppressed, (SELECT count(DISTINCT track_id) FROM m WHERE gone) AS stale_reassociation_track_ids_dropped,
  (SELECT count(*) FROM m WHERE edge AND NOT gone) AS edge_observations_skipped, (SELECT count(*) FROM m WHERE edge AND NOT gone AND pos % 9 <> 0) AS tracks_discarded_edge_contact,
  (SELECT count(*) FROM m WHERE gap > 30 AND NOT gone) AS world_reassociation_observations_accepted, (SELECT count(DISTINCT track_id) FROM m WHERE gap > 30 AND NOT gone) AS world_reassociation_tracks_retained,
  (SELECT count(*) FROM s WHERE mw < 255 OR mh < 150) AS tracks_hidden_from_render_crop_eligibility""")
def analysis_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diagnosed(spark, sf_dir).drop("confidence_histogram", "box_width_histogram")


@query(f"""WITH {_DIAGNOSTICS},
v AS (SELECT 'confidence' AS name, confidence AS x FROM obs UNION ALL SELECT 'width', w FROM m WHERE NOT gone AND NOT edge AND pos % 9 <> 0),
b AS (SELECT 'confidence' AS name, i, i / 10.0::DOUBLE AS low, CASE WHEN i = 9 THEN 1.01::DOUBLE ELSE (i + 1) / 10.0::DOUBLE END AS high FROM range(10) r(i)
  UNION ALL SELECT 'width', i, w[i + 1], w[i + 2] FROM range(10) r(i), (SELECT [0.0, 40, 80, 120, 160, 200, 300, 400, 600, 800, NULL]::DOUBLE[] AS w))
SELECT name, low AS "min", high AS "max", count(x) AS "count" FROM b LEFT JOIN v USING (name) WHERE false OR x IS NULL OR (x >= low AND (high IS NULL OR x < high OR (i = 9 AND x = high))) GROUP BY name, i, low, high
UNION ALL SELECT name, low, high, 0 FROM b WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.name = b.name AND (v.x IS NULL OR (v.x >= low AND (high IS NULL OR v.x < high OR (i = 9 AND v.x = high)))))""")
def diagnostic_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _diagnosed(spark, sf_dir)
    one = lambda name, column: found.select(F.lit(name).alias("name"), F.inline(column))
    return one("confidence", "confidence_histogram").union(one("width", "box_width_histogram"))


def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    crops = rows.groupBy("run_id", "track_id").agg(F.collect_list(F.when(F.col("confidence") >= 0.97, F.col("pos"))).alias("candidates"))
    summaries = tracks.track_metrics(rows).join(crops, ["run_id", "track_id"])
    kept = tracks.retire_stale(rows, fx(), fy(), after=30.0, world_gap=60.0, reach=400.0, speed=10.0)
    gone = rows.join(kept.select("pos"), "pos", "left_anti")
    named = lambda r: r.withColumn("track_id", F.when(F.col("pos") % 9 == 0, -1).otherwise(F.col("track_id")))
    edge = boxes.touches_frame_edge(box(), 0, 0, WIDTH, HEIGHT, 15)
    outputs = named(rows).join(kept.select("pos", (~edge).alias("stays")), "pos", "left").withColumn("stays", F.coalesce("stays", F.lit(False)) & (F.col("track_id") >= 0))
    retained = tracks.steps(kept, fx(), fy()).where("gap > 30")
    hidden = summaries.where(~filters.size_eligible(F.col("max_width"), F.col("max_height"), 255, 150))
    return aggregates.diagnostics(rows.select("frame_index").distinct(), rows, outputs, summaries, gone, frames_needed=60, width=255, height=150, edges=named(kept.where(edge)), retained=retained, hidden=hidden)


def _states(spark: SparkSession, sf_dir: str, **limits) -> DataFrame:
    rows = filters.inside_roi(observations(spark, sf_dir), ZONE)
    rows = rows.select("run_id", "track_id", "frame_index", "pos", "t", fx().alias("x"), fy().alias("y"), "inside_roi")
    return run_once(rows, lambda stream: track_states(stream, **limits), "states")


@query(oracle_sql()["retired_tracks"])
def retired_as_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir, after=30.0, world_gap=60.0, reach=400.0, speed=10.0).where("not retired")
    return rows.groupBy("track_id").agg(F.count("*").alias("kept"), F.max("frame_index").alias("last_frame"))


@query(oracle_sql()["line_counts"])
def line_counts_as_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _states(spark, sf_dir, after=1e9, line=LINE, direction="A_TO_B")
    first = F.min(F.when(F.col("counted"), F.col("frame_index"))).alias("crossed_at")
    return rows.groupBy("track_id").agg(F.count_if(F.col("crossing") == "A_TO_B").alias("downwards"), F.count_if(F.col("crossing") == "B_TO_A").alias("upwards"), first, F.count_if("counted").alias("counted_rows"))


@query(f"""WITH {OBSERVATIONS}, z AS (SELECT pos, vehicle_index, bool_or({polygon_sql("fx", "fy")}) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS counted FROM feet)
SELECT pos, counted FROM z""")
def zone_counts_as_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir, after=1e9).select("pos", "counted")


@query("""SELECT vec_id, len(embedding) = 64 AS fits, list_cosine_distance(embedding::DOUBLE[], embedding::DOUBLE[]) < 1e-9 AS self_is_near FROM embeddings""")
def embedding_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", vectors.is_embedding(v, 64).alias("fits"), (vectors.cosine_distance(v, v) < 1e-9).alias("self_is_near"))
