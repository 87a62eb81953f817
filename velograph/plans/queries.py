"""Queries of the operators over the driver's tables, each with the SQL of the same result where SQL has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.functions import boxes, geometry, text, vectors
from velograph.operators import aggregates, dedup, filters, joins, link, report, retrieval, smooth, tracker, tracks
from velograph.plans.driver_tables import FRAGMENTS, HEIGHT, LINE, OBSERVATIONS, WIDTH, ZONE, edge_sql, fragments, observations, polygon_sql, read
from velograph.plans.registry import oracle_sql, queries, query
from velograph.sources.readers import sampled_frames_of

__all__ = ["flagship", "oracle_sql", "queries"]

def r6(c: Column | str) -> Column:
    return F.round(c, 6)


def fx() -> Column:
    return F.col("bbox.x1") / 2 + F.col("bbox.x2") / 2


def fy() -> Column:
    return F.col("bbox.y2")


def width() -> Column:
    return boxes.width(F.col("bbox"))


IN_ZONE = polygon_sql("fx", "fy")
ORDERED = "PARTITION BY track_id ORDER BY frame_index, pos"


@query(f"""WITH {OBSERVATIONS},
z AS (SELECT *, bool_or({IN_ZONE}) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS counted FROM feet)
SELECT class_name, count(*) FILTER (WHERE counted) AS counted_rows, count(DISTINCT vehicle_index) FILTER (WHERE counted) AS vehicles FROM z GROUP BY class_name""")
def zone_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.counted_in_zone(filters.inside_roi(observations(spark, sf_dir), ZONE))
    return rows.groupBy("class_name").agg(F.count_if("counted").alias("counted_rows"), F.count_distinct(F.when(F.col("counted"), F.col("vehicle_index"))).alias("vehicles"))


@query(f"""WITH {OBSERVATIONS}
SELECT track_id, count(*) AS frames_seen, min(frame_index) AS first_frame, max(frame_index) AS last_frame, min(w) AS min_width, max(w) AS max_width, min(h) AS min_height, max(h) AS max_height FROM feet GROUP BY track_id""")
def track_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.track_metrics(observations(spark, sf_dir)).drop("run_id")


@query(f"""WITH {OBSERVATIONS},
s AS (SELECT track_id, t - lag(t) OVER w AS gap, sqrt((fx - lag(fx) OVER w) ** 2 + (fy - lag(fy) OVER w) ** 2) AS dist FROM feet WINDOW w AS ({ORDERED}))
SELECT track_id, round(median(dist / gap), 6) AS speed_median, round(max(dist / gap), 6) AS speed_max FROM s WHERE gap > 0 GROUP BY track_id""")
def track_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.speeds(observations(spark, sf_dir), fx(), fy())
    return found.select("track_id", r6("speed_median").alias("speed_median"), r6("speed_max").alias("speed_max"))


@query(f"""WITH {OBSERVATIONS},
s AS (SELECT *, t - lag(t) OVER w AS gap, sqrt((fx - lag(fx) OVER w) ** 2 + (fy - lag(fy) OVER w) ** 2) AS dist FROM feet WINDOW w AS ({ORDERED})),
m AS (SELECT *, coalesce(bool_or(gap > 30 AND NOT (gap <= 60 AND dist <= least(400, gap * 10))) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING), false) AS gone FROM s)
SELECT track_id, count(*) AS kept, max(frame_index) AS last_frame FROM m WHERE NOT gone GROUP BY track_id""")
def retired_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tracks.retire_stale(observations(spark, sf_dir), fx(), fy(), after=30.0, world_gap=60.0, reach=400.0, speed=10.0)
    return kept.groupBy("track_id").agg(F.count("*").alias("kept"), F.max("frame_index").alias("last_frame"))


@query(f"""WITH {OBSERVATIONS},
s AS (SELECT *, {IN_ZONE} AS inside, CASE WHEN fx BETWEEN 0 AND 1000 THEN CASE WHEN fy > 300 THEN 1 WHEN fy < 300 THEN -1 END END AS side FROM feet),
p AS (SELECT *, last_value(side IGNORE NULLS) OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
c AS (SELECT *, CASE WHEN side <> before THEN CASE WHEN side > 0 THEN 'A_TO_B' ELSE 'B_TO_A' END END AS crossing FROM p),
n AS (SELECT *, sum(CASE WHEN crossing = 'A_TO_B' AND inside THEN 1 ELSE 0 END) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS n FROM c)
SELECT track_id, count(*) FILTER (WHERE crossing = 'A_TO_B') AS downwards, count(*) FILTER (WHERE crossing = 'B_TO_A') AS upwards,
  min(frame_index) FILTER (WHERE crossing = 'A_TO_B' AND inside AND n = 1) AS crossed_at, count(*) FILTER (WHERE n >= 1) AS counted_rows FROM n GROUP BY track_id""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.line_crossings(filters.inside_roi(observations(spark, sf_dir), ZONE), *LINE, fx(), fy())
    rows = tracks.first_crossing(rows, "A_TO_B")
    return rows.groupBy("track_id").agg(
        F.count_if(F.col("crossing") == "A_TO_B").alias("downwards"), F.count_if(F.col("crossing") == "B_TO_A").alias("upwards"),
        F.min(F.when(F.col("crossed_line"), F.col("frame_index"))).alias("crossed_at"), F.count_if("counted").alias("counted_rows"),
    )


@query(f"""WITH {OBSERVATIONS},
p AS (SELECT *, lag(x1) OVER w AS a1, lag(y1) OVER w AS b1, lag(x2) OVER w AS a2, lag(y2) OVER w AS b2 FROM obs WINDOW w AS ({ORDERED})),
i AS (SELECT *, greatest(least(x2, a2) - greatest(x1, a1), 0) * greatest(least(y2, b2) - greatest(y1, b1), 0) AS shared, (x2 - x1) * (y2 - y1) AS s, (a2 - a1) * (b2 - b1) AS o FROM p WHERE a1 IS NOT NULL)
SELECT pos, round(shared / (s + o - shared), 6) AS iou, round(shared / least(s, o), 6) AS coverage, round(least(s, o) / greatest(s, o), 6) AS area_ratio,
  round(sqrt(((x1 + x2) / 2 - (a1 + a2) / 2) ** 2 + ((y1 + y2) / 2 - (b1 + b2) / 2) ** 2), 6) AS distance,
  round(sqrt(((x1 + x2) / 2 - (a1 + a2) / 2) ** 2 + ((y1 + y2) / 2 - (b1 + b2) / 2) ** 2) / greatest(x2 - x1, y2 - y1, a2 - a1, b2 - b1), 6) AS error FROM i""")
def box_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("before", F.lag("bbox").over(tracks.along())).where("before is not null")
    a, b = F.col("bbox"), F.col("before")
    return rows.select("pos", r6(boxes.iou(a, b)).alias("iou"), r6(boxes.smaller_coverage(a, b)).alias("coverage"), r6(boxes.area_ratio(a, b)).alias("area_ratio"), r6(boxes.center_distance(a, b)).alias("distance"), r6(boxes.center_error(b, a)).alias("error"))


@query(f"""WITH {OBSERVATIONS},
c AS (SELECT class_name, least(greatest(x1, 0), 699) AS x1, least(greatest(y1, 0), 479) AS y1, least(greatest(x2, 0), 699) AS x2, least(greatest(y2, 0), 479) AS y2 FROM obs WHERE class_name IN ('click', 'view'))
SELECT class_name, count(*) AS boxes, sum(x2 - x1) AS widths, sum(y2 - y1) AS heights, count(*) FILTER (WHERE x2 - x1 >= 112 AND y2 - y1 >= 56) AS large FROM c WHERE x2 > x1 AND y2 > y1 GROUP BY class_name""")
def clipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filters.clip_to_frame(filters.class_filter(observations(spark, sf_dir), ["Click", "VIEW"]), 700, 480)
    return rows.groupBy("class_name").agg(F.count("*").alias("boxes"), F.sum(width()).alias("widths"), F.sum(boxes.height(F.col("bbox"))).alias("heights"), F.count_if(filters.size_gate(F.col("bbox"))).alias("large"))


@query(f"""WITH {OBSERVATIONS},
b AS (SELECT * FROM (VALUES (0, 0.0, 0.25), (1, 0.25, 0.5), (2, 0.5, 0.9), (3, 0.9, 0.95)) AS v(bin, low, high))
SELECT bin, CAST(low AS DOUBLE) AS low, CAST(high AS DOUBLE) AS high, count(confidence) AS n FROM b LEFT JOIN obs ON confidence >= low AND (confidence < high OR (bin = 3 AND confidence = high)) GROUP BY bin, low, high""")
def confidence_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.histogram(observations(spark, sf_dir), F.col("confidence"), [0.0, 0.25, 0.5, 0.9, 0.95])


@query(f"""WITH {OBSERVATIONS},
f AS (SELECT vehicle_index, arg_min(class_name, pos + 1e9 * frame_index) AS make FROM obs WHERE vehicle_index IS NOT NULL GROUP BY vehicle_index),
c AS (SELECT make, count(*) AS n FROM f GROUP BY make)
SELECT make, n, round(n / CAST((SELECT max(n) FROM c) AS DOUBLE), 6) AS progress FROM c ORDER BY n DESC, make LIMIT 15""")
def make_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.make_counts(observations(spark, sf_dir).withColumnRenamed("class_name", "make")).withColumn("progress", r6("progress"))


_ENDS = f"""{FRAGMENTS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_index DESC, pos DESC) AS back FROM frag),
firsts AS (SELECT track_id, t AS ft, fx AS ffx, fy AS ffy FROM (SELECT *, row_number() OVER ({ORDERED}) AS n FROM frag) WHERE n = 1),
froms AS (SELECT track_id, t AS st, fx AS sx, fy AS sy FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY back DESC) AS k FROM numbered WHERE back <= 3) WHERE k = 1),
lasts AS (SELECT track_id, t AS lt, fx AS lx, fy AS ly, vehicle_index FROM numbered WHERE back = 1),
counts AS (SELECT track_id, count(*) AS frames_seen, min(frame_index) AS first_frame, max(frame_index) AS last_frame FROM frag GROUP BY track_id),
ends AS (SELECT *, CASE WHEN lt > st THEN (lx - sx) / (lt - st) END AS vx, CASE WHEN lt > st THEN (ly - sy) / (lt - st) END AS vy FROM counts JOIN firsts USING (track_id) JOIN lasts USING (track_id) JOIN froms USING (track_id))"""
_PAIRS = f"""{_ENDS},
near AS (SELECT a.track_id AS a_track_id, b.track_id AS b_track_id, a.first_frame AS a_first_frame, b.first_frame AS b_first_frame, b.ft - a.lt AS gap, sqrt((b.ffx - a.lx) ** 2 + (b.ffy - a.ly) ** 2) AS dist, abs(b.ffx - a.lx) AS aside,
    (b.ffx - a.lx) * a.vx + (b.ffy - a.ly) * a.vy AS dot, sqrt(a.vx ** 2 + a.vy ** 2) AS v FROM ends a JOIN ends b ON b.ft > a.lt AND b.ft <= a.lt + 0.4::DOUBLE AND a.track_id <> b.track_id),
passing AS (SELECT * FROM near WHERE dist > 0 AND dist <= 200 AND aside <= 150 AND dist / gap <= 5000 AND (v IS NULL OR dist < 1 OR v < 1 OR dot > 0)),
links AS (SELECT *, row_number() OVER (PARTITION BY a_track_id ORDER BY gap, aside, dist, a_first_frame, a_track_id, b_first_frame, b_track_id) = 1 AND row_number() OVER (PARTITION BY b_track_id ORDER BY gap, aside, dist, a_first_frame, a_track_id, b_first_frame, b_track_id) = 1 AS accepted FROM passing)"""


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.endpoints(fragments(observations(spark, sf_dir)), fx(), fy())


def _links(ends: DataFrame) -> DataFrame:
    return link.links(ends, max_gap=0.4, max_distance=200.0, max_lateral=150.0, max_speed=5000.0)


@query(f"""WITH {OBSERVATIONS}, {_ENDS}
SELECT track_id, frames_seen, round(ft, 6) AS first_t, round(lt, 6) AS last_t, lx AS last_x, ly AS last_y, round(vx, 6) AS vx, round(vy, 6) AS vy, vehicle_index FROM ends""")
def track_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _ends(spark, sf_dir)
    return e.select("track_id", "frames_seen", r6("first.t").alias("first_t"), r6("last.t").alias("last_t"), F.col("last.x").alias("last_x"), F.col("last.y").alias("last_y"), r6("vx").alias("vx"), r6("vy").alias("vy"), "vehicle_index")


@query(f"""WITH {OBSERVATIONS}, {_PAIRS}
SELECT a_track_id, b_track_id, round(gap, 6) AS gap, round(aside, 6) AS "lateral", round(dist, 6) AS dist, accepted FROM links""")
def track_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(_ends(spark, sf_dir)).select("a_track_id", "b_track_id", r6("gap").alias("gap"), r6("lateral").alias("lateral"), r6("dist").alias("dist"), "accepted")


@query(f"""WITH RECURSIVE {OBSERVATIONS}, {_PAIRS},
edges AS (SELECT a_track_id AS a, b_track_id AS b FROM links WHERE accepted UNION SELECT b_track_id, a_track_id FROM links WHERE accepted),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
parts AS (SELECT a AS track_id, min(b) AS component FROM reach GROUP BY a),
m AS (SELECT p.component, p.track_id, e.vehicle_index, e.first_frame FROM parts p JOIN ends e USING (track_id)),
named AS (SELECT component, vehicle_index FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY first_frame, track_id) AS n FROM m WHERE vehicle_index IS NOT NULL) WHERE n = 1)
SELECT track_id, component, named.vehicle_index FROM m JOIN named USING (component)""")
def linked_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _ends(spark, sf_dir)
    return link.merged_vehicles(ends, _links(ends)).select("track_id", "component", "vehicle_index")


_DUPLICATES = f"""{FRAGMENTS},
n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_index DESC, pos DESC) AS back, row_number() OVER ({ORDERED}) AS forth FROM frag),
a AS (SELECT l.track_id, l.vehicle_index, l.t, l.class_name, l.x1, l.y1, l.x2, l.y2, p.t AS pt, p.x1 AS p1, p.y1 AS q1, p.x2 AS p2, p.y2 AS q2 FROM n l LEFT JOIN n p ON p.track_id = l.track_id AND p.back = 2 WHERE l.back = 1),
b AS (SELECT track_id, vehicle_index, t, class_name, x1, y1, x2, y2 FROM n WHERE forth = 1),
k AS (SELECT track_id, min(class_name) AS make FROM frag GROUP BY track_id),
j AS (SELECT a.track_id AS a_track_id, b.track_id AS b_track_id, a.vehicle_index AS av, b.vehicle_index AS bv, b.t - a.t AS gap, ka.make = kb.make AS identity_match, CASE WHEN a.pt < a.t THEN (b.t - a.t) / (a.t - a.pt) ELSE 0 END AS f,
    a.x1, a.y1, a.x2, a.y2, coalesce(p1, a.x1) AS p1, coalesce(q1, a.y1) AS q1, coalesce(p2, a.x2) AS p2, coalesce(q2, a.y2) AS q2, b.x1 AS u1, b.y1 AS v1, b.x2 AS u2, b.y2 AS v2
  FROM a JOIN b ON b.t > a.t AND b.t <= a.t + 2 AND a.track_id <> b.track_id JOIN k ka ON ka.track_id = a.track_id JOIN k kb ON kb.track_id = b.track_id
  WHERE a.vehicle_index IS NOT NULL AND b.vehicle_index IS NOT NULL),
g AS (SELECT *, (x1 + x2) / 2 + ((x1 + x2) / 2 - (p1 + p2) / 2) * f AS cx, (y1 + y2) / 2 + ((y1 + y2) / 2 - (q1 + q2) / 2) * f AS cy,
    greatest((x2 - x1) + ((x2 - x1) - (p2 - p1)) * f, 0) AS w, greatest((y2 - y1) + ((y2 - y1) - (q2 - q1)) * f, 0) AS h FROM j)"""


def _duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fragments(observations(spark, sf_dir))
    labels = rows.groupBy("run_id", "track_id").agg(F.max("vehicle_index").alias("vehicle_index"), F.min("class_name").alias("make")).withColumn("accepted", F.lit(True))
    return dedup.duplicate_pairs(dedup.track_ends(rows), labels, max_gap=2.0, parts=["make"])


@query(f"""WITH {OBSERVATIONS}, {_DUPLICATES}
SELECT a_track_id, b_track_id, round(gap, 6) AS gap, identity_match,
  round(sqrt((cx - (u1 + u2) / 2) ** 2 + (cy - (v1 + v2) / 2) ** 2) / greatest(w, h, u2 - u1, v2 - v1), 6) AS error,
  round(least(w, u2 - u1) / greatest(w, u2 - u1), 6) AS width_ratio, round(least(h, v2 - v1) / greatest(h, v2 - v1), 6) AS height_ratio FROM g""")
def duplicate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _duplicates(spark, sf_dir).select("a_track_id", "b_track_id", r6("gap").alias("gap"), "identity_match", r6("error").alias("error"), r6("width_ratio").alias("width_ratio"), r6("height_ratio").alias("height_ratio"))


@query("""SELECT o_orderkey, o_custkey, CAST(event_id AS BIGINT) AS event_id, event_type FROM
(SELECT o_orderkey, o_custkey, o_custkey % 20 AS user_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (o_orderkey % 700) AS at FROM orders) o ASOF LEFT JOIN events e ON o.user_id = e.user_id AND o.at >= e.ts""")
def latest_event_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("o_orderkey") % 700).cast("int"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 20).alias("user_id"), at.alias("ts"))
    events = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type")
    return joins.asof(orders, events, "ts", ["user_id"], ["event_id", "event_type"]).select("o_orderkey", "o_custkey", "event_id", "event_type")


_RECORDS = f"""{OBSERVATIONS},
ranked AS (SELECT *, dense_rank() OVER (ORDER BY frame_index) - 1 AS position, row_number() OVER (PARTITION BY track_id, frame_index ORDER BY pos) AS dup FROM feet),
rec AS (SELECT * FROM ranked WHERE dup = 1),
fr AS (SELECT frame_index, min(t) AS t, min(position) AS position FROM ranked GROUP BY frame_index)"""


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """One observation of a track in a frame, with positions, and the frames."""
    rows = joins.first_wins(observations(spark, sf_dir), ["run_id", "track_id", "frame_index"], ["pos"])
    rows = rows.withColumns({"counted": F.lit(False), "crossed_line": F.lit(False)})
    frames = smooth.record_positions(observations(spark, sf_dir).groupBy("run_id", "frame_index").agg(F.min("t").alias("t")))
    return rows.join(frames.select("run_id", "frame_index", "position"), ["run_id", "frame_index"]), frames


@query(f"""WITH {_RECORDS},
n AS (SELECT *, lead(position) OVER w AS np, lead(t) OVER w AS nt, lead(x1) OVER w AS n1, lead(y2) OVER w AS n2, lead(confidence) OVER w AS nc FROM rec WINDOW w AS ({ORDERED})),
g AS (SELECT *, unnest(range(position + 1, np)) AS at FROM n WHERE np - position - 1 BETWEEN 1 AND 40),
m AS (SELECT g.*, fr.frame_index AS f, least(greatest((fr.t - g.t) / (nt - g.t), 0), 1) AS ratio FROM g JOIN fr ON fr.position = g.at)
SELECT track_id, f AS frame_index, round(x1 + (n1 - x1) * ratio, 6) AS x1, round(y2 + (n2 - y2) * ratio, 6) AS y2, round(confidence + (nc - confidence) * ratio, 6) AS confidence FROM m""")
def bridged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = smooth.bridge_gaps(*_records(spark, sf_dir), most=40)
    return made.select("track_id", "frame_index", r6("bbox.x1").alias("x1"), r6("bbox.y2").alias("y2"), r6("confidence").alias("confidence"))


@query(f"""WITH {_RECORDS},
g AS (SELECT *, CASE WHEN position - lag(position) OVER ({ORDERED}) - 1 > 60 THEN 1 ELSE 0 END AS brk FROM rec)
SELECT track_id, CAST(sum(brk) AS BIGINT) + 1 AS segments, count(*) AS n FROM g GROUP BY track_id""")
def track_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _records(spark, sf_dir)
    return tracks.segments(rows, F.col("position"), most=60).groupBy("track_id").agg((F.max("segment") + 1).alias("segments"), F.count("*").alias("n"))


@query(f"""WITH {_RECORDS},
g AS (SELECT *, CASE WHEN position - lag(position) OVER ({ORDERED}) - 1 > 15 THEN 1 ELSE 0 END AS brk FROM rec),
s AS (SELECT *, sum(brk) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS seg FROM g),
i AS (SELECT *, row_number() OVER (PARTITION BY track_id, seg ORDER BY frame_index, pos) - 1 AS i, count(*) OVER (PARTITION BY track_id, seg) AS n FROM s),
c AS (SELECT *, least(n, 5) AS span, least(greatest(i - least(n, 5) // 2, 0), n - least(n, 5)) AS first FROM i),
l AS (SELECT a.track_id, a.frame_index, a.pos, any_value(a.fx) AS fx, any_value(a.w) AS w, any_value(a.h) AS h, count(*) AS k, regr_slope(b.fx, b.frame_index) AS sx, regr_intercept(b.fx, b.frame_index) AS ix, regr_slope(b.w, b.frame_index) AS sw, regr_intercept(b.w, b.frame_index) AS iw
  FROM c a JOIN c b ON a.track_id = b.track_id AND a.seg = b.seg AND b.i >= a.first AND b.i < a.first + a.span GROUP BY a.track_id, a.frame_index, a.pos),
v AS (SELECT *, CASE WHEN k >= 2 THEN sx * frame_index + ix ELSE fx END AS px, CASE WHEN k >= 2 THEN sw * frame_index + iw ELSE w END AS pw FROM l),
o AS (SELECT *, least(greatest(px, fx - w * 0.1::DOUBLE), fx + w * 0.1::DOUBLE) AS qx, greatest(least(greatest(pw, w - w * 0.1::DOUBLE), w + w * 0.1::DOUBLE), 1) AS qw FROM v)
SELECT pos, round(qx, 4) AS center_x, round(qw, 4) AS width FROM o""")
def fitted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _records(spark, sf_dir)
    s = smooth.fitted_boxes(rows)
    return s.select("pos", F.round(boxes.center(F.col("smooth"))["x"], 4).alias("center_x"), F.round(boxes.width(F.col("smooth")), 4).alias("width"))


@query(f"""WITH {_RECORDS},
g AS (SELECT *, CASE WHEN position - lag(position) OVER ({ORDERED}) > 1 THEN 1 ELSE 0 END AS brk FROM rec),
s AS (SELECT *, sum(brk) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS seg FROM g)
SELECT pos, round(avg(x1) OVER w, 6) AS x1, round(avg(y2) OVER w, 6) AS y2 FROM s WINDOW w AS (PARTITION BY track_id, seg ORDER BY frame_index, pos ROWS 2 PRECEDING)""")
def averaged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _records(spark, sf_dir)
    return smooth.moving_average(rows, 3).select("pos", r6("smooth.x1").alias("x1"), r6("smooth.y2").alias("y2"))


@query(f"""WITH {OBSERVATIONS},
z AS (SELECT *, bool_or({IN_ZONE}) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS counted FROM feet),
f AS (SELECT vehicle_index, min(frame_index) AS frame_index FROM z WHERE counted AND vehicle_index IS NOT NULL GROUP BY vehicle_index)
SELECT frame_index, (SELECT count(*) FROM f WHERE f.frame_index <= a.frame_index) AS vehicles FROM (SELECT DISTINCT frame_index FROM obs) a""")
def running_vehicle_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.counted_in_zone(filters.inside_roi(observations(spark, sf_dir), ZONE))
    return tracks.running_vehicles(rows, rows.select("run_id", "frame_index").distinct()).select("frame_index", "vehicles")


@query(f"""WITH {OBSERVATIONS},
n AS (SELECT *, row_number() OVER (PARTITION BY frame_index, vehicle_index ORDER BY pos) AS n FROM obs),
e AS (SELECT *, (row_number() OVER ({ORDERED}) - 1) % 3 = 0 AS third FROM n WHERE vehicle_index IS NULL OR n = 1)
SELECT track_id, count(*) AS shown, count(*) FILTER (WHERE third) AS every_third FROM e GROUP BY track_id""")
def shown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tracks.first_in_frame(observations(spark, sf_dir))
    third = tracks.every_nth(rows, 3).groupBy("track_id").agg(F.count("*").alias("every_third"))
    return rows.groupBy("track_id").agg(F.count("*").alias("shown")).join(third, "track_id")


@query(f"""WITH {OBSERVATIONS},
m AS (SELECT track_id, min(frame_index) AS first_frame, max(w) AS mw, max(vehicle_index) AS v, count(*) AS n FROM feet GROUP BY track_id)
SELECT track_id, row_number() OVER (ORDER BY first_frame, track_id) AS vehicle_index FROM m WHERE mw >= 112 AND n >= 20""")
def numbered_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = filters.min_lifetime(tracks.track_metrics(observations(spark, sf_dir)), 20).where(filters.size_eligible(F.col("max_width"), F.lit(None).cast("double")))
    return tracks.number_vehicles(m.withColumn("candidates", F.array(F.lit(1)))).select("track_id", F.col("vehicle_index").cast("long").alias("vehicle_index"))


_OVERLAP = f"""{OBSERVATIONS},
q AS (SELECT frame_index // 20 AS bin, * REPLACE (frame_index // 20 AS frame_index), frame_index AS f0 FROM feet),
o AS (SELECT a.pos, least(1, coalesce(sum(CASE WHEN a.pos <> b.pos THEN greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) / (a.w * a.h) END), 0)) AS overlap FROM q a JOIN q b ON a.bin = b.bin GROUP BY a.pos)"""


def _overlapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.sibling_overlap(observations(spark, sf_dir).withColumn("frame_index", F.floor(F.col("frame_index") / 20)))


@query(f"WITH {_OVERLAP} SELECT pos, round(overlap, 6) AS overlap FROM o")
def sibling_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlapped(spark, sf_dir).select("pos", r6("overlap").alias("overlap"))


@query(f"""WITH {_OVERLAP},
m AS (SELECT track_id, min(w) AS lo, max(w) AS hi FROM feet GROUP BY track_id),
c AS (SELECT q.*, CASE WHEN overlap <= 0.1 THEN 2 WHEN overlap <= 0.5 THEN 1 ELSE 0 END AS tier, CASE WHEN hi > lo THEN abs((w - lo) / (hi - lo) - 0.75::DOUBLE) ELSE 0 END AS err FROM q JOIN o USING (pos) JOIN m USING (track_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY vehicle_index ORDER BY tier DESC, err, confidence DESC, w * h DESC, frame_index, pos) AS n FROM c WHERE vehicle_index IS NOT NULL)
SELECT vehicle_index, track_id, pos FROM r WHERE n = 1""")
def best_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _overlapped(spark, sf_dir)
    m = tracks.track_metrics(observations(spark, sf_dir)).select("run_id", "track_id", "min_width", "max_width")
    c = rows.join(m, ["run_id", "track_id"]).where("vehicle_index is not null").withColumns({"width": width(), "sharpness": F.col("confidence"), "edge_margin": F.lit(0.0), "area": boxes.area(F.col("bbox")), "ord": F.col("pos")})
    return aggregates.best_crop(c, "run_id", "vehicle_index").select("vehicle_index", "track_id", "pos")


@query(f"""WITH {OBSERVATIONS},
n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_index DESC, pos DESC) AS back FROM feet)
SELECT track_id, round(regr_slope(fx, t), 5) AS vx, round(regr_slope(fy, t), 5) AS vy FROM n WHERE back <= 5 GROUP BY track_id""")
def fitted_velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = tracks.fitted_velocity(observations(spark, sf_dir), fx(), fy())
    return v.select("track_id", F.round("vx", 5).alias("vx"), F.round("vy", 5).alias("vy"))


_PHASH = "(vec_id * 2654435761) % 4294967296"


def _vectors(spark: SparkSession, sf_dir: str, separated: bool) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    v = F.transform("embedding", lambda x, i: x.cast("double") + F.when(F.lit(separated) & (i == F.col("label")), 10.0).otherwise(0.0))
    return e.select(F.lit("c").alias("contract"), F.col("vec_id").alias("ord"), v.alias("embedding"), "label", F.expr(_PHASH).alias("phash"))


def _calibration_sql(separated: bool) -> str:
    v = "list_transform(embedding, lambda x, i: x::DOUBLE + CASE WHEN i = label + 1 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END)" if separated else "embedding::DOUBLE[]"
    return f"""WITH e AS (SELECT vec_id, label, {v} AS v FROM embeddings),
p AS (SELECT greatest(0, list_cosine_distance(a.v, b.v)) AS d, a.label = b.label AS same FROM e a JOIN e b ON a.vec_id < b.vec_id),
s AS (SELECT count(*) FILTER (WHERE same) AS same_pairs, count(*) FILTER (WHERE NOT same) AS conflict_pairs, max(d) FILTER (WHERE same) AS max_same, min(d) FILTER (WHERE NOT same) AS min_conflict FROM p)
SELECT same_pairs, conflict_pairs, round(max_same, 6) AS max_same, round(min_conflict, 6) AS min_conflict, CASE WHEN same_pairs >= 1 AND conflict_pairs >= 1 AND max_same < min_conflict THEN round(max_same, 6) END AS threshold FROM s"""


def _calibrated(spark: SparkSession, sf_dir: str, separated: bool) -> DataFrame:
    c = retrieval.calibration(_vectors(spark, sf_dir, separated), F.col("label"), keys=["contract"])
    return c.select("same_pairs", "conflict_pairs", r6("max_same").alias("max_same"), r6("min_conflict").alias("min_conflict"), r6("threshold").alias("threshold"))


@query(_calibration_sql(False))
def calibration_without_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, False)


@query(_calibration_sql(True))
def calibration_with_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calibrated(spark, sf_dir, True)


@query(f"""WITH h AS (SELECT p_partkey, p_partkey % 300 * 65536 * 65537 + p_partkey % 7 AS phash FROM part)
SELECT a.p_partkey AS query_id, b.p_partkey AS record_id, CAST(bit_count(xor(a.phash, b.phash)) AS INTEGER) AS hamming FROM h a JOIN h b ON a.p_partkey % 10 = 0 AND b.p_partkey % 10 <> 0 AND bit_count(xor(a.phash, b.phash)) <= 3""")
def near_image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = read(spark, sf_dir, "part").select(F.lit("c").alias("contract"), "p_partkey", (F.col("p_partkey") % 300 * 65536 * 65537 + F.col("p_partkey") % 7).alias("phash"))
    q = h.where("p_partkey % 10 = 0").withColumnRenamed("p_partkey", "query_id")
    r = h.where("p_partkey % 10 <> 0").withColumnRenamed("p_partkey", "record_id")
    return retrieval.near_hashes(q, r, 3, ["contract"]).select("query_id", "record_id", "hamming")


@query("""SELECT o_orderkey AS record_id FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders s WHERE s.o_orderkey % 5 = 0 AND s.o_orderkey - 3 = o.o_orderkey)""")
def active_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") - 3).alias("supersedes_record_id"))
    return joins.active_records(records).select("record_id")


_DECIDED = """WITH p AS (SELECT p_partkey, p_name, p_brand, p_type, p_size FROM part),
q AS (SELECT p_partkey AS query_id, p_partkey % 3 <> 0 AS has_embedding, p_size FROM p WHERE p_partkey % 4 = 0),
s AS (SELECT *, CASE p_partkey % 12 WHEN 1 THEN (p_brand, p_type, '', p_size, '', 0) WHEN 5 THEN (p_brand, '', p_type, 0, p_type, p_size) ELSE ('', '', '', 0, '', 0) END AS sig FROM p WHERE p_partkey % 4 = 1),
x AS (SELECT query_id, min(r.p_partkey) AS rec, bool_and(r.p_size % 5 <> 0) AS able, count(DISTINCT sig) AS sigs FROM q JOIN s r ON r.p_partkey // 36 = query_id // 36 AND r.p_size // 10 = q.p_size // 10 AND query_id % 8 = 0 GROUP BY query_id),
w AS (SELECT query_id, r.p_partkey AS rec, r.p_size % 3 AS image, CAST(r.p_partkey % 10 AS DOUBLE) / 100 AS d, r.p_size % 11 <> 0 AS able, lower(r.p_brand) AS ident FROM q JOIN p r ON r.p_partkey % 4 IN (2, 3) AND r.p_partkey // 40 = query_id // 40),
i AS (SELECT query_id, bool_or(n > 1) AS split, count(*) AS images FROM (SELECT query_id, image, count(DISTINCT ident) AS n FROM w GROUP BY query_id, image) GROUP BY query_id),
a AS (SELECT query_id, bool_and(able) AS able, count(DISTINCT ident) AS ids FROM w GROUP BY query_id),
r AS (SELECT q.query_id, CASE WHEN x.able = false THEN 'exact_ineligible' WHEN x.sigs > 1 THEN 'exact_conflict' WHEN x.able THEN 'exact_match' WHEN a.able IS NULL THEN 'no_match' WHEN NOT has_embedding THEN 'embedding_unavailable'
  WHEN a.able = false THEN 'embedding_ineligible' WHEN i.split THEN 'embedding_conflict' WHEN i.images < 2 THEN 'insufficient_neighbors' WHEN a.ids > 1 THEN 'embedding_conflict' ELSE 'embedding_match' END AS reason, coalesce(images, 0) AS neighbours
  FROM q LEFT JOIN x USING (query_id) LEFT JOIN a USING (query_id) LEFT JOIN i USING (query_id))
"""


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions about parts, with labels made from their columns."""
    p = read(spark, sf_dir, "part")
    q = p.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("query_id"), (F.col("p_partkey") % 3 != 0).alias("has_embedding"), F.col("p_size").alias("q_size"))
    kind = F.col("p_partkey") % 12

    def result(able: Column, varied: bool) -> Column:
        """Labels that differ, for the exact records, in names, confidences, tags or boxes only."""
        on = lambda k, c: F.when(F.lit(varied) & (kind == k), c)
        brand = F.col("p_brand") if not varied else F.when(kind.isin(1, 5), F.col("p_brand")).otherwise("b")
        size = F.col("p_size").cast("double")
        given = {
            "make": brand, "model": F.lit("m"), "view": on(1, F.col("p_type")), "color_confidence": on(1, size), "category": on(5, F.col("p_type")),
            "tags": on(5, F.array(F.struct(F.col("p_type").alias("name")))), "detection_box": on(5, boxes.box(size, size, size + 1, size + 1)), "make_confidence": F.lit(0.9),
        }
        blank = lambda f: F.lit(None).cast("double" if f.endswith("_confidence") else "string")
        return F.struct(*[given.get(f, blank(f)).alias(f) for f in retrieval.SIGNATURE], able.alias("accepted"))

    def records(rest: list[int], able: Column, varied: bool) -> DataFrame:
        own = p.where((F.col("p_partkey") % 4).isin(rest))
        return own.select(F.col("p_partkey").alias("record_id"), (F.col("p_size") % 3).alias("image"), "p_size", result(able, varied).alias("result"), F.lit(False).alias("by_human"))

    part = lambda c, n: F.floor(F.col(c) / n)
    first = records([1], F.col("p_size") % 5 != 0, True)
    exact = q.where("query_id % 8 = 0").join(first, (part("query_id", 36) == part("record_id", 36)) & (part("q_size", 10) == part("p_size", 10)))
    second = records([2, 3], F.col("p_size") % 11 != 0, False)
    within = q.join(second, part("query_id", 40) == part("record_id", 40)).withColumns({"distance": F.col("record_id") % 10 / 100.0, "hamming": F.lit(0)})
    return retrieval.decisions(q, exact, within.select("query_id").distinct(), within, enforce=True, calibrated=True)


@query(f"""{_DECIDED}SELECT query_id, reason, CASE WHEN reason IN ('exact_match', 'exact_ineligible', 'embedding_match') THEN 'reuse' ELSE 'api_fallback' END AS action, neighbours FROM r""")
def retrieval_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(spark, sf_dir).select("query_id", "reason", "action", "neighbours")


@query("""WITH r AS (SELECT p_partkey AS rec, p_partkey // 8 AS grp, p_size % 3 AS image, CASE WHEN p_partkey // 8 % 3 = 0 THEN 'make ' || p_partkey % 2 ELSE 'make' END AS make, p_partkey % 10 / 100.0::DOUBLE AS d,
  CASE WHEN p_partkey // 8 % 2 = 0 THEN CASE WHEN p_partkey % 4 = 2 THEN ' Turbo' ELSE 'turbo ' END WHEN p_partkey // 8 % 5 = 0 THEN NULL ELSE 'v' || p_partkey % 2 END AS variation FROM part WHERE p_partkey % 4 IN (2, 3)),
q AS (SELECT p_partkey AS query_id, p_partkey // 8 AS grp FROM part WHERE p_partkey % 4 = 0),
w AS (SELECT * FROM q JOIN r USING (grp)),
i AS (SELECT query_id, max(n) > 1 AS split, count(*) AS images FROM (SELECT query_id, image, count(DISTINCT make) AS n FROM w GROUP BY query_id, image) GROUP BY query_id),
g AS (SELECT query_id, count(DISTINCT make) AS ids, count(DISTINCT coalesce(lower(trim(variation)), '')) AS variations, arg_min((rec, make, variation), (d, rec)) AS best FROM w GROUP BY query_id),
e AS (SELECT query_id, rec, make, variation FROM q JOIN r ON rec = query_id + 2 WHERE query_id % 16 = 0),
f AS (SELECT q.query_id, e.rec AS exact, e.make AS em, e.variation AS ev, best, variations, CASE WHEN e.rec IS NOT NULL THEN 'exact_match' WHEN images IS NULL THEN 'no_match' WHEN split THEN 'embedding_conflict' WHEN images < 2 THEN 'insufficient_neighbors' WHEN ids > 1 THEN 'embedding_conflict' ELSE 'embedding_match' END AS reason
  FROM q LEFT JOIN i USING (query_id) LEFT JOIN g USING (query_id) LEFT JOIN e USING (query_id))
SELECT query_id, reason, CASE reason WHEN 'exact_match' THEN exact WHEN 'embedding_match' THEN best[1] END AS record_id, CASE reason WHEN 'exact_match' THEN em WHEN 'embedding_match' THEN best[2] END AS make,
  CASE WHEN reason = 'exact_match' THEN ev WHEN reason = 'embedding_match' AND variations = 1 THEN best[3] END AS variation, CASE WHEN reason = 'exact_match' THEN 'red' END AS color FROM f""")
def decided_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that lookups give: variations agree, differ or are missing by groups of records."""
    p, key = read(spark, sf_dir, "part"), F.col("p_partkey")
    group = F.floor(key / 8)
    given = {
        "make": F.when(group % 3 == 0, F.concat(F.lit("make "), key % 2)).otherwise("make"), "model": F.lit("m"), "make_confidence": F.lit(0.9), "color": F.lit("red"),
        "variation": F.when(group % 2 == 0, F.when(key % 4 == 2, " Turbo").otherwise("turbo ")).when(group % 5 != 0, F.concat(F.lit("v"), key % 2)), "tags": F.array(F.struct(F.lit("tag").alias("name"))),
    }
    label = F.struct(*[given.get(f, F.lit(None).cast("double" if f.endswith("_confidence") else "string")).alias(f) for f in retrieval.SIGNATURE], F.lit(True).alias("accepted"))
    records = p.where(key % 4 >= 2).select(key.alias("record_id"), group.alias("group"), (F.col("p_size") % 3).alias("image"), label.alias("result"), F.lit(False).alias("by_human"))
    q = p.where(key % 4 == 0).select(key.alias("query_id"), group.alias("group"), F.lit(True).alias("has_embedding"))
    exact = q.where("query_id % 16 = 0").drop("group").join(records, F.col("record_id") == F.col("query_id") + 2)
    within = q.join(records, "group").withColumns({"distance": F.col("record_id") % 10 / 100.0, "hamming": F.lit(0)})
    found = retrieval.decisions(q.drop("group"), exact, within.select("query_id").distinct(), within, enforce=True, calibrated=True)
    return found.select("query_id", "reason", "record_id", "result.make", "result.variation", "result.color")


@query(r"""SELECT p_partkey, lower(trim(p_name)) AS identity, 'tag_' || trim(regexp_replace(lower(p_type || ' / ' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS tag, p_size % 2 = 1 AS affirmative FROM part""")
def label_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    word = F.when(F.col("p_size") % 2 == 1, F.when(F.col("p_size") % 4 == 1, "Yes").otherwise("1")).otherwise(F.when(F.col("p_size") % 4 == 0, "no").otherwise("0"))
    return p.select("p_partkey", text.normal_identity(F.concat(F.lit(" "), "p_name", F.lit("\t"))).alias("identity"), text.tag_column(F.concat("p_type", F.lit(" / "), "p_brand", F.lit("!"))).alias("tag"), text.is_affirmative(word).alias("affirmative"))


@query("""WITH l AS (SELECT p_partkey AS track_id, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 97 END AS vehicle_index, p_brand AS make, p_type AS tag, p_size % 2 = 1 AS yes, CAST(p_size AS DOUBLE) / 100 AS conf FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY coalesce('v' || vehicle_index, 't' || track_id) ORDER BY track_id) AS n FROM l)
SELECT CAST(track_id AS VARCHAR) AS track_id, coalesce(CAST(vehicle_index AS VARCHAR), '') AS vehicle_index, make,
  CASE WHEN yes AND tag = 'ECONOMY' THEN 'yes' ELSE '' END AS tag_economy, CASE WHEN yes AND tag = 'ECONOMY' THEN CAST(conf AS VARCHAR) ELSE '' END AS tag_economy_confidence,
  CASE WHEN yes AND tag = 'SMALL' THEN 'yes' ELSE '' END AS tag_small FROM f WHERE n = 1""")
def vehicle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    tag = F.struct(F.col("p_type").alias("name"), F.when(F.col("p_size") % 2 == 1, "true").otherwise("false").alias("value"), (F.col("p_size") / 100.0).alias("score"), F.lit(None).cast("double").alias("confidence"))
    labels = p.select(F.lit("r").alias("run_id"), F.col("p_partkey").alias("track_id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_partkey") % 97).alias("vehicle_index"), F.lit(None).cast("int").alias("api_classification_index"), F.col("p_brand").alias("make"), F.array(tag).alias("tags"))
    return report.report(labels).select("track_id", "vehicle_index", "make", "tag_economy", "tag_economy_confidence", "tag_small")


@query("""SELECT s_suppkey, n_name AS flag, r_name AS powertrain FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT DISTINCT ON (n_nationkey, n_name) n_nationkey AS k, n_name AS nn, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) d ON d.k = s_nationkey AND d.nn = n_name""")
def dimension_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = read(spark, sf_dir, "supplier").join(read(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("model")), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    rows = rows.select("s_suppkey", F.col("s_nationkey").cast("string").alias("make"), "model", F.lit("g").alias("generation"), F.lit(None).cast("string").alias("variation"))
    key = F.col("n_nationkey").cast("string").alias("make")
    out = report.with_dimensions(rows, n.select(key, F.col("n_name").alias("flag")), n.select(key, F.col("n_name").alias("model"), F.lit("g").alias("generation"), F.lit("").alias("variation"), F.col("r_name").alias("powertrain")))
    return out.select("s_suppkey", "flag", "powertrain")


@query("""WITH v AS (SELECT p_partkey, p_size * 9 AS n, 15 + p_partkey % 20 + 0.97::DOUBLE AS f, 4.0::DOUBLE + p_size % 9 AS g FROM part WHERE p_size % 10 = 3),
k AS (SELECT *, unnest(range(n)) AS i FROM v),
t AS (SELECT *, CAST(floor((i / f + 1e-9::DOUBLE) / (1.0::DOUBLE / least(f, g))) AS BIGINT) AS p, CAST(floor(((i - 1) / f + 1e-9::DOUBLE) / (1.0::DOUBLE / least(f, g))) AS BIGINT) AS q FROM k)
SELECT p_partkey AS run_id, i AS frame_index, round(i / f, 6) AS t FROM t WHERE i = 0 OR p > q OR i = n - 1""")
def sampled_video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one kind stand for videos, with lengths and rates of their own."""
    size, key = F.col("p_size"), F.col("p_partkey")
    videos = read(spark, sf_dir, "part").where(size % 10 == 3).select(key.alias("run_id"), (size * 9).alias("frames"), (15 + key % 20 + F.lit(0.97)).alias("source_fps"), (4.0 + size % 9).alias("target_fps"))
    return sampled_frames_of(videos, terminal=True).select("run_id", "frame_index", r6("t").alias("t"))


@query(f"""WITH {OBSERVATIONS},
e AS (SELECT *, floor(x1) <= 15 OR floor(y1) <= 15 OR ceil(x2) >= {WIDTH} - 16 OR ceil(y2) >= {HEIGHT} - 16 AS edge, frame_index // 10 AS bin FROM obs),
d AS (SELECT * FROM e WHERE edge AND class_name = 'view')
SELECT pos FROM e WHERE NOT edge AND NOT EXISTS (SELECT 1 FROM d WHERE d.bin = e.bin AND
  greatest(least(e.x2, d.x2) - greatest(e.x1, d.x1), 0) * greatest(least(e.y2, d.y2) - greatest(e.y1, d.y1), 0) >=
  0.5 * ((e.x2 - e.x1) * (e.y2 - e.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) - greatest(least(e.x2, d.x2) - greatest(e.x1, d.x1), 0) * greatest(least(e.y2, d.y2) - greatest(e.y1, d.y1), 0)))""")
def edge_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("frame_index", F.floor(F.col("frame_index") / 10))
    edge = boxes.touches_frame_edge(F.col("bbox"), 0, 0, WIDTH, HEIGHT, 15)
    return filters.drop_edge_observations(rows, rows.where(edge & (F.col("class_name") == "view")), edge).select("pos")


@query(f"""WITH {OBSERVATIONS},
m AS (SELECT track_id, count(*) AS n, max(w) AS mw, max(h) AS mh FROM feet GROUP BY track_id)
SELECT count(*) AS tracks, count(*) FILTER (WHERE mw < 258) AS without_crops, count(*) FILTER (WHERE mw < 258 AND mw < 257) AS too_narrow, count(*) FILTER (WHERE mw < 258 AND mh < 159) AS too_low, count(*) FILTER (WHERE n < 60) AS too_short FROM m""")
def crop_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = tracks.track_metrics(observations(spark, sf_dir))
    m = m.withColumn("candidates", F.when(F.col("max_width") < 258, F.array()).otherwise(F.array(F.lit(1))))
    return aggregates.conditional_counts(m, width=257, height=159, frames=60)


@query(f"""WITH {OBSERVATIONS},
m AS (SELECT track_id, count(*) AS n, max(w) AS mw, max(h) AS mh, max(vehicle_index) AS v FROM feet GROUP BY track_id)
SELECT track_id FROM m WHERE n >= 40 AND v IS NOT NULL AND mw >= 250 AND mh >= 150""")
def visible_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    return filters.visible_tracks(rows, tracks.track_metrics(rows), 40, width=250, height=150).select("track_id")


@query(f"""WITH {OBSERVATIONS},
h AS (SELECT track_id, frame_index, pos, t, fx * 0.05::DOUBLE AS wx, fy * 0.1::DOUBLE AS wy FROM feet),
s AS (SELECT track_id, t - lag(t) OVER w AS gap, sqrt((wx - lag(wx) OVER w) ** 2 + (wy - lag(wy) OVER w) ** 2) AS dist FROM h WINDOW w AS ({ORDERED}))
SELECT track_id, round(median(dist / gap), 5) AS speed_median FROM s WHERE gap > 0 GROUP BY track_id""")
def world_speeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = geometry.fit_homography([(0, 0), (1000, 0), (1000, 600), (0, 600)], [(0, 0), (50, 0), (50, 60), (0, 60)])
    at = geometry.to_world(fx(), fy(), h)
    return tracks.speeds(observations(spark, sf_dir), at["x"], at["y"]).select("track_id", F.round("speed_median", 5).alias("speed_median"))


@query(f"""WITH {OBSERVATIONS},
m AS (SELECT track_id, any_value(vehicle_index) AS vehicle_index, min(frame_index) AS first_frame, count(*) AS n FROM obs GROUP BY track_id),
v AS (SELECT vehicle_index, min(first_frame) AS first_frame, min(track_id) AS least_track, CAST(sum(n) AS BIGINT) AS frames_seen, count(*) AS tracks FROM m WHERE vehicle_index IS NOT NULL GROUP BY vehicle_index)
SELECT vehicle_index, frames_seen, tracks, CAST(row_number() OVER (ORDER BY first_frame, least_track) AS INTEGER) AS place, CAST((row_number() OVER (ORDER BY first_frame, least_track) - 1) // 8 AS INTEGER) AS chunk FROM v""")
def vehicle_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir)
    m = tracks.track_metrics(rows).join(rows.select("run_id", "track_id", "vehicle_index").distinct(), ["run_id", "track_id"])
    v = aggregates.chunks(aggregates.vehicles_of_tracks(m), 8, "first_frame", "least_track")
    return v.select("vehicle_index", "frames_seen", F.size("tracks").cast("long").alias("tracks"), "place", "chunk")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 2 = 0 AS even FROM events WHERE json_extract(props, '$.k') IS NOT NULL""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k"), (k % 2 == 0).alias("even")).where("k is not null")


@query("""WITH u AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, 'Brand' || k AS make, nullif(CAST(k AS DOUBLE) / 100, 0) AS make_confidence, CASE WHEN k % 3 <> 0 THEN k % 3 ELSE 0 END AS best FROM u WHERE k IS NOT NULL""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")

    def user(size: str) -> str:
        return '{"box":{"position":{"topLeftCol":0,"topLeftRow":0,"bottomRightCol":' + size + ',"bottomRightRow":10,"score":0.5}},"mmr":{"make":{"value":" Brand%1$s ","score":%2$s}}}'

    answer = F.format_string('{"data":{"combinations":[{"roadUsers":[' + user("%3$s") + ',7]},{"roadUsers":[' + user("%4$s") + ']},{"roadUsers":[' + user("%5$s") + "]}]}}", k.cast("string"), (k / 100.0).cast("string"), F.when(k % 3 == 0, "20").otherwise("10"), F.when(k % 3 == 1, "20").otherwise("10"), F.when(k % 3 == 2, "20").otherwise("10"))
    users = report.parsed_users(report.road_users(read(spark, sf_dir, "events").where(k.isNotNull()).select("event_id", answer.alias("answer"))))
    best = report.best_user(users.select("event_id", "combination", "user", "make", "make_confidence", "model_confidence", "detection_box", "detection_confidence"), "event_id")
    return best.select("event_id", "make", "make_confidence", F.col("combination").cast("long").alias("best"))


@query("""SELECT event_type AS class_name, time_bucket(INTERVAL 6 HOUR, ts) AS window_start, count(*) AS n FROM events GROUP BY 1, 2""")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp_ntz"), "6 hours")
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("class_name"), w.alias("w")).agg(F.count("*").alias("n")).select("class_name", F.col("w.start").alias("window_start"), "n")


@query(f"""WITH {OBSERVATIONS},
f AS (SELECT frame_index // 50 AS frame_index, list(struct_pack(x1 := x1, y1 := y1, x2 := x2, y2 := y2, pos := pos) ORDER BY confidence DESC, pos) AS l FROM obs GROUP BY 1),
k AS (SELECT frame_index, list_reduce(list_transform(l, lambda e: [e]), lambda kept, x: CASE WHEN len(list_filter(kept, lambda e:
    2 * greatest(least(e.x2, x[1].x2) - greatest(e.x1, x[1].x1), 0) * greatest(least(e.y2, x[1].y2) - greatest(e.y1, x[1].y1), 0)
    > (e.x2 - e.x1) * (e.y2 - e.y1) + (x[1].x2 - x[1].x1) * (x[1].y2 - x[1].y1) - greatest(least(e.x2, x[1].x2) - greatest(e.x1, x[1].x1), 0) * greatest(least(e.y2, x[1].y2) - greatest(e.y1, x[1].y1), 0))) = 0
  THEN list_concat(kept, x) ELSE kept END) AS kept FROM f),
u AS (SELECT frame_index, unnest(kept) AS e FROM k)
SELECT frame_index, e.pos AS pos FROM u""")
def suppressed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("frame_index", F.floor(F.col("frame_index") / 50))
    return tracker.suppress(rows, 0.5).select("frame_index", "pos")


_WORTH = "CASE WHEN greatest(a.high, x.high) > least(a.low, x.low) THEN -abs(({0}.w - least(a.low, x.low)) / (greatest(a.high, x.high) - least(a.low, x.low)) - 0.75::DOUBLE) ELSE 0 END, {0}.sharp, {0}.area"


@query(f"""WITH {OBSERVATIONS},
l AS (SELECT track_id, list(struct_pack(low := w, high := w, since := t, updates := 1, frame := frame_index, w := w, sharp := confidence, area := w * h) ORDER BY frame_index, pos) AS l FROM feet GROUP BY track_id),
k AS (SELECT track_id, list_reduce(l, lambda a, x: CASE WHEN x.since - a.since >= 12 AND ({_WORTH.format("x")}) > ({_WORTH.format("a")})
  THEN struct_pack(low := least(a.low, x.low), high := greatest(a.high, x.high), since := x.since, updates := a.updates + 1, frame := x.frame, w := x.w, sharp := x.sharp, area := x.area)
  ELSE struct_pack(low := least(a.low, x.low), high := greatest(a.high, x.high), since := a.since, updates := a.updates, frame := a.frame, w := a.w, sharp := a.sharp, area := a.area) END) AS a FROM l)
SELECT 'r' AS run_id, track_id, a.frame AS frame_index, CAST(a.updates AS INTEGER) AS updates FROM k""")
def kept_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumns({"width": width(), "tier": F.lit(2), "sharpness": F.col("confidence"), "edge_margin": F.lit(0.0), "area": boxes.area(F.col("bbox"))})
    return tracker.select_crops(rows.select("run_id", "track_id", "frame_index", "pos", "t", "width", "tier", "sharpness", "edge_margin", "area"), spacing=12.0)


@query()
def associated_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.associate(observations(spark, sf_dir, 64)).select("run_id", "pos", "track_id")


@query(f"""WITH {OBSERVATIONS}, {_ENDS},
e AS (SELECT track_id, ft, lt, ffx / 20 AS ffx, ffy / 10 AS ffy, lx / 20 AS lx, ly / 10 AS ly, vx / 20 AS vx, vy / 10 AS vy FROM ends),
n AS (SELECT b.track_id AS spawn_id, a.track_id, b.ft - a.lt AS gap, sqrt((b.ffx - a.lx) ** 2 + (b.ffy - a.ly) ** 2) AS moved, b.ffx - (a.lx + a.vx * (b.ft - a.lt)) AS dx, b.ffy - (a.ly + a.vy * (b.ft - a.lt)) AS dy, a.vx, a.vy, sqrt(a.vx ** 2 + a.vy ** 2) AS v
  FROM e a JOIN e b ON b.ft > a.lt AND b.ft <= a.lt + 2),
r AS (SELECT *, CASE WHEN vx IS NULL THEN 'history' WHEN moved / gap > 40 THEN 'speed' WHEN sqrt(dx ** 2 + dy ** 2) > 4 THEN 'prediction' WHEN v >= 1 AND abs(dx * vy - dy * vx) / v > 2 THEN 'lateral' WHEN v >= 1 AND (dx * vx + dy * vy) / v < -1.5::DOUBLE THEN 'behind' END AS reason FROM n)
SELECT spawn_id, track_id, reason, reason IS NULL AND row_number() OVER (PARTITION BY spawn_id ORDER BY reason IS NOT NULL, sqrt(dx ** 2 + dy ** 2), track_id) = 1 AS chosen FROM r""")
def rescued_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fragments(observations(spark, sf_dir))
    ends = tracks.endpoints(rows, fx() / 20, fy() / 10)
    lost = ends.select("run_id", "track_id", "last.t", "last.x", "last.y", "vx", "vy")
    spawns = ends.select("run_id", F.col("track_id").alias("spawn_id"), "first.t", "first.x", "first.y")
    return tracker.rescue_pairs(spawns, lost, gap=2.0).select("spawn_id", "track_id", "reason", "chosen")


@query("""SELECT a.vec_id AS query_id, b.vec_id AS record_id, round(greatest(0, list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distance
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id WHERE greatest(0, list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) <= 0.8::DOUBLE""")
def embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 50 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    pairs = retrieval.within_distance(q, e.select("label", F.col("vec_id").alias("record_id"), "embedding"), threshold=0.8, keys=["label"])
    return pairs.where("query_id <> record_id").select("query_id", "record_id", r6("distance").alias("distance"))


@query(f"""WITH {OBSERVATIONS},
n AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame_index DESC, pos DESC) AS back FROM feet),
l AS (SELECT * FROM n WHERE back = 1), p AS (SELECT * FROM n WHERE back = 2)
SELECT l.track_id, round(l.fx + (l.fx - p.fx) * (1 / (l.t - p.t)), 4) AS center_x, round(greatest(l.w + (l.w - p.w) * (1 / (l.t - p.t)), 0), 4) AS width FROM l JOIN p USING (track_id) WHERE l.t > p.t""")
def extrapolated_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = dedup.track_ends(observations(spark, sf_dir)).where("before is not null and last.t > before.t")
    b = tracks.extrapolate(F.col("before"), F.col("last"), F.col("last.t") + 1)
    return ends.withColumn("b", b).select("track_id", F.round(boxes.center(F.col("b"))["x"], 4).alias("center_x"), F.round(F.col("b.x2") - F.col("b.x1"), 4).alias("width"))


@query(f"""WITH {_RECORDS},
st AS (SELECT frame_index, t, lead(frame_index) OVER (ORDER BY frame_index) AS nf, lead(t) OVER (ORDER BY frame_index) AS nt FROM fr),
b AS (SELECT s.*, p.track_id, p.x1 AS p1, n.x1 AS n1 FROM (SELECT * FROM st WHERE nf - frame_index > 1 AND nt > t AND nt - t <= 5) s JOIN rec p ON p.frame_index = s.frame_index JOIN rec n ON n.frame_index = s.nf AND n.track_id = p.track_id),
x AS (SELECT *, unnest(range(frame_index + 1, nf)) AS f FROM b)
SELECT track_id, f AS frame_index, round(p1 + (n1 - p1) * least(greatest((f / 10.0::DOUBLE - t) / (nt - t), 0), 1), 6) AS x1 FROM x""")
def interpolated_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, frames = _records(spark, sf_dir)
    made, _ = smooth.interpolate_frames(rows, frames, 10.0, max_gap=5.0)
    return made.select("track_id", "frame_index", r6("bbox.x1").alias("x1"))


@query("""SELECT p_brand AS make, count(*) FILTER (WHERE p_size >= 20 AND p_type <> 'SMALL') AS accepted, count(*) FILTER (WHERE p_partkey % 3 <> 0 AND p_type <> 'SMALL' AND (p_partkey % 5 = 0 OR p_size >= 35)) AS eligible FROM part GROUP BY p_brand""")
def accepted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    sure = F.col("p_size") / 100.0
    ok = filters.accepted(F.col("p_brand"), model, sure, 0.2)
    able = filters.evidence_eligible(F.col("p_partkey") % 3 != 0, F.col("p_brand"), model, sure, F.col("p_partkey") % 5 == 0, 0.35)
    return read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("make")).agg(F.count_if(ok).alias("accepted"), F.count_if(able).alias("eligible"))


@query("""SELECT o_custkey % 10 AS run_id, count(*) FILTER (WHERE o_orderkey % 4 <> 0) AS imported, count(*) FILTER (WHERE o_orderkey % 4 = 0) AS skipped FROM orders GROUP BY 1""")
def seed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("run_id"), F.col("o_orderkey").alias("record_id"))
    return retrieval.seed_summary(rows, retrieval.seed(rows.where("record_id % 4 = 0"), rows))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 12 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.session_window(F.col("ts").cast("timestamp_ntz"), "12 hours")
    rows = read(spark, sf_dir, "events").groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


@query(f"""WITH {_RECORDS},
st AS (SELECT frame_index, t, lead(frame_index) OVER (ORDER BY frame_index) AS nf, lead(t) OVER (ORDER BY frame_index) AS nt FROM fr)
SELECT frame_index + 1 AS frame_index FROM st WHERE nf - frame_index > 1 AND nt > t AND NOT (nt - t <= 0.5 AND EXISTS (SELECT 1 FROM rec p JOIN rec n ON n.track_id = p.track_id WHERE p.frame_index = st.frame_index AND n.frame_index = st.nf))""")
def cleared_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, frames = _records(spark, sf_dir)
    return smooth.interpolate_frames(rows, frames, 10.0, max_gap=0.5)[1].select("frame_index")


@query("""SELECT p_partkey, sha256(p_name || '{"brand":"' || p_brand || '","size":' || p_size || '}') AS key, CAST(p_partkey % 256 AS INTEGER) AS blue, p_size AS red FROM part""")
def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    colour = F.format_string("#%02X%02X%02X", "p_size", F.floor(F.col("p_partkey") / 256) % 256, F.col("p_partkey") % 256)
    request = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return read(spark, sf_dir, "part").select("p_partkey", text.content_key(F.col("p_name"), request).alias("key"), text.hex_to_bgr(colour)[0].alias("blue"), text.hex_to_bgr(colour)[2].alias("red"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_brand ELSE p_brand || ' ' || p_type || chr(10) || CASE WHEN p_size % 2 = 0 THEN 'G' || p_size || chr(10) ELSE '' END || p_name END AS label FROM part""")
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.col("p_size") % 5 == 0
    either = lambda c: F.when(old, F.lit("old")).otherwise(c)
    generation = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("G"), F.col("p_size").cast("string")))
    label = text.display_label(F.lit(None).cast("string"), F.col("p_brand"), either(F.col("p_type")), F.lit(""), either(generation), either(F.col("p_name")))
    return read(spark, sf_dir, "part").select("p_partkey", label.alias("label"))


@query(f"""WITH {OBSERVATIONS},
l AS (SELECT track_id, frame_index, pos, fx, fy, lag(fx) OVER w AS px, lag(fy) OVER w AS py FROM feet WINDOW w AS ({ORDERED})),
d AS (SELECT *, fy - py AS step FROM l)
SELECT track_id, round(max(step), 6) AS down, round(min(step), 6) AS up, count(*) FILTER (WHERE px IS NULL) AS firsts FROM d GROUP BY track_id""")
def steps_along_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tracks.along()
    rows = observations(spark, sf_dir).withColumns({"step": fy() - F.lag(fy()).over(w), "before": F.lag(fx()).over(w)})
    return rows.groupBy("track_id").agg(r6(F.max("step")).alias("down"), r6(F.min("step")).alias("up"), F.count_if(F.col("before").isNull()).alias("firsts"))


@query(f"""WITH RECURSIVE {OBSERVATIONS}, {_DUPLICATES},
o AS (SELECT *, greatest(least(cx + w / 2, u2) - greatest(cx - w / 2, u1), 0) * greatest(least(cy + h / 2, v2) - greatest(cy - h / 2, v1), 0) AS shared FROM g),
r AS (SELECT av, bv, identity_match, sqrt((cx - (u1 + u2) / 2) ** 2 + (cy - (v1 + v2) / 2) ** 2) / greatest(w, h, u2 - u1, v2 - v1) AS error,
    least(least(w, u2 - u1) / greatest(w, u2 - u1), least(h, v2 - v1) / greatest(h, v2 - v1)) AS ratio, shared / (w * h + (u2 - u1) * (v2 - v1) - shared) AS iou FROM o),
e AS (SELECT av AS a, bv AS b FROM r WHERE av <> bv AND CASE WHEN identity_match THEN error <= 1 AND ratio >= 0.55::DOUBLE ELSE error <= 0.35::DOUBLE AND ratio >= 0.75::DOUBLE AND iou >= 0.1::DOUBLE END),
edges AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, x.b FROM reach r JOIN edges x ON r.b = x.a)
SELECT a AS vehicle_index, least(a, min(b)) AS canonical FROM reach GROUP BY a""")
def merged_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.canonical_vehicles(_duplicates(spark, sf_dir)).select("vehicle_index", "canonical")


@query(f"""WITH {OBSERVATIONS} SELECT class_name, count(*) FILTER (WHERE {edge_sql()}) AS touching, count(*) AS n FROM obs GROUP BY class_name""")
def polygon_edge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = geometry.touches_polygon_edge(F.col("bbox"), ZONE)
    return observations(spark, sf_dir).groupBy("class_name").agg(F.count_if(flag).alias("touching"), F.count("*").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zone_counts(spark, sf_dir)


from velograph.plans import more_queries, stream_queries, upkeep_queries  # noqa: E402, F401  these build on the ones above
