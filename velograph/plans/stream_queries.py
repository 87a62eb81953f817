"""Queries of the operators with state over frames and of services behind a store of answers, with SQL over whole tables."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.functions import boxes
from velograph.operators import filters
from velograph.operators.recognition import recognized
from velograph.plans.driver_tables import HEIGHT, LINE, OBSERVATIONS, WIDTH, ZONE, observations, polygon_sql
from velograph.plans.materialize import shared_dir
from velograph.plans.queries import r6, read, width
from velograph.plans.registry import query
from velograph.sources.answers import Folder, answered
from velograph.sources.avi import read_frames, write_frames
from velograph.streaming.counting import run_in_parts
from velograph.streaming.frames import Settings, frame_loop, rows_of
from velograph.streaming.memory import Limits

RUNS = 16
SETTINGS = Settings(after=30.0, world_gap=60.0, reach=400.0, speed=10.0, line=LINE, edge_iou=0.3, spacing=12.0)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of ``RUNS`` runs in frames of two seconds, with what a frame alone decides; every fortieth is a flagged
    detection."""
    rows = filters.inside_roi(observations(spark, sf_dir, RUNS), ZONE)
    corners = [F.col(f"bbox.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")]
    edge = boxes.touches_frame_edge(F.col("bbox"), 0, 0, WIDTH, HEIGHT, 15)
    return rows.select(
        "run_id", F.floor(F.col("frame_index") / 20).alias("frame_index"), "pos", "t", *corners, "confidence", "track_id", "inside_roi", edge.alias("edge"), (F.col("pos") % 40 == 0).alias("flagged"),
        F.col("confidence").alias("sharpness"), F.lit(0.0).alias("edge_margin"), boxes.area(F.col("bbox")).alias("crop_area"), F.array(width(), (F.col("track_id") % 7).cast("double"), F.lit(1.0)).alias("vector"), F.lit(False).alias("ends"),
    )


def in_thirds(rows: DataFrame) -> list[DataFrame]:
    """The rows in three stretches of time, the last with a row that ends each run."""
    low, high = rows.agg(F.min("frame_index"), F.max("frame_index")).first()
    bounds = [low + (high - low) // 3, low + 2 * (high - low) // 3] if low is not None else [0, 0]
    ends = rows.select("run_id").distinct().select("run_id", F.lit(high).cast("long").alias("frame_index"), F.lit(0).cast("long").alias("pos"), F.lit(True).alias("ends"))
    at = F.col("frame_index")
    return [rows.where(at <= bounds[0]), rows.where((at > bounds[0]) & (at <= bounds[1])), rows.where(at > bounds[1]).unionByName(ends, allowMissingColumns=True)]


def _iou(a: str, b: str) -> str:
    shared = f"greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1), 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1), 0)"
    return f"{shared} >= 0.3::DOUBLE * ({a}.w * {a}.h + {b}.w * {b}.h - {shared})"


_ALONG = "PARTITION BY track_id ORDER BY frame_index, pos"
_WORTH = "({0}.tier, -abs({0}.w - (x.low + (x.high - x.low) * 0.75::DOUBLE)) / greatest(x.low + (x.high - x.low) * 0.75::DOUBLE, 1), {0}.sharp, {0}.w * {0}.h, -{0}.frame)"
_LOOP = f"""{OBSERVATIONS},
f AS (SELECT * REPLACE (frame_index // 20 AS frame_index), track_id % {RUNS} AS run, pos % 40 = 0 AS flagged, {polygon_sql("fx", "fy")} AS inside,
  floor(x1) <= 15 OR floor(y1) <= 15 OR ceil(x2) >= {WIDTH} - 16 OR ceil(y2) >= {HEIGHT} - 16 AS edge FROM feet),
s AS (SELECT *, t - lag(t) OVER ({_ALONG}) AS gap, sqrt((fx - lag(fx) OVER ({_ALONG})) ** 2 + (fy - lag(fy) OVER ({_ALONG})) ** 2) AS dist FROM f WHERE NOT flagged),
m AS (SELECT *, coalesce(bool_or(gap > 30 AND NOT (gap <= 60 AND dist <= least(400, gap * 10))) OVER ({_ALONG} ROWS UNBOUNDED PRECEDING), false) AS gone FROM s),
k AS (SELECT * FROM m WHERE NOT gone AND NOT edge AND NOT EXISTS (SELECT 1 FROM f g WHERE g.flagged AND g.run = m.run AND g.frame_index = m.frame_index AND {_iou("m", "g")})),
l AS (SELECT *, CASE WHEN fx BETWEEN 0 AND 1000 THEN CASE WHEN fy > 300 THEN 1 WHEN fy < 300 THEN -1 END END AS side FROM k),
p AS (SELECT *, last_value(side IGNORE NULLS) OVER ({_ALONG} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
c AS (SELECT *, CASE WHEN side <> before AND inside THEN CASE WHEN side > 0 THEN 'A_TO_B' ELSE 'B_TO_A' END END AS crossing FROM p),
n AS (SELECT *, count(crossing) OVER ({_ALONG} ROWS UNBOUNDED PRECEDING) AS n FROM c),
r AS (SELECT *, n >= 1 AS counted, n = 1 AND crossing IS NOT NULL AS crossed_line, CASE WHEN n = 1 THEN crossing END AS direction, min(w) OVER ({_ALONG} ROWS UNBOUNDED PRECEDING) AS low, max(w) OVER ({_ALONG} ROWS UNBOUNDED PRECEDING) AS high FROM n),
o AS (SELECT a.pos, least(1, coalesce(sum(CASE WHEN a.pos <> b.pos THEN greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) END), 0) / (a.w * a.h)) AS overlap FROM r a JOIN r b ON a.run = b.run AND a.frame_index = b.frame_index GROUP BY a.pos, a.w, a.h),
t AS (SELECT track_id, list(struct_pack(low := low, high := high, since := t, updates := 1, frame := frame_index, w := w, h := h, sharp := confidence, tier := CASE WHEN overlap <= 0.1::DOUBLE THEN 2 WHEN overlap <= 0.5 THEN 1 ELSE 0 END) ORDER BY frame_index, pos) AS l FROM r JOIN o USING (pos) WHERE w >= 112 AND h >= 56 GROUP BY track_id),
h AS (SELECT track_id, list_reduce(l, lambda a, x: CASE WHEN x.since - a.since >= 12 AND {_WORTH.format("a")} < {_WORTH.format("x")}
  THEN struct_pack(low := x.low, high := x.high, since := x.since, updates := a.updates + 1, frame := x.frame, w := x.w, h := x.h, sharp := x.sharp, tier := x.tier) ELSE a END) AS a FROM t)"""


@query(f"""WITH {_LOOP}
SELECT CAST(any_value(run) AS VARCHAR) AS run_id, track_id, count(*) AS frames_seen, min(frame_index) AS first_frame, max(frame_index) AS last_frame, min(w) AS min_width, max(w) AS max_width, min(h) AS min_height, max(h) AS max_height,
  bool_or(counted) AS counted, min(frame_index) FILTER (WHERE crossed_line) AS counted_frame, min(direction) AS direction, any_value(a.frame) AS crop_frame, CAST(coalesce(any_value(a.updates), 0) AS BIGINT) AS crop_updates FROM r LEFT JOIN h USING (track_id) GROUP BY track_id""")
def frame_loop_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three streams, each from the state that the one before it left."""
    return rows_of(run_in_parts(in_thirds(frames(spark, sf_dir)), lambda rows: frame_loop(rows, SETTINGS), "frame-loop"), "track")


@query(f"""WITH {_LOOP}, d AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE gone) AS gone, count(DISTINCT track_id) FILTER (WHERE gone) AS ids, count(*) FILTER (WHERE NOT gone) AS stayed FROM m GROUP BY run),
a AS (SELECT run, count(*) AS kept, count(*) FILTER (WHERE crossed_line) AS events FROM r GROUP BY run),
u AS (SELECT run, sum(a.updates) AS crops FROM h JOIN (SELECT DISTINCT run, track_id FROM f) USING (track_id) GROUP BY run),
e AS (SELECT * FROM d LEFT JOIN a USING (run) LEFT JOIN u USING (run))
SELECT CAST(run AS VARCHAR) AS run_id, name, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (
  SELECT run, unnest(['rows', 'suppressed', 'ids_dropped', 'edge_skipped', 'accepted', 'counted', 'crops']) AS name, unnest([n, gone, ids, stayed - coalesce(kept, 0), kept, events, crops]) AS n FROM e)""")
def frame_loop_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_thirds(frames(spark, sf_dir))
    out = run_in_parts([rows[0].unionByName(rows[1]).unionByName(rows[2])], lambda rows: frame_loop(rows, SETTINGS), "frame-counts")
    return rows_of(out, "count").where(F.col("name").isin("rows", "suppressed", "ids_dropped", "edge_skipped", "accepted", "counted", "crops"))


@query(f"""WITH {_LOOP} SELECT CAST(run AS VARCHAR) AS run_id, frame_index, pos, t, track_id, inside AS inside_roi, counted, crossed_line, direction FROM (SELECT * REPLACE (CASE WHEN crossed_line THEN direction END AS direction) FROM r)""")
def frame_loop_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows_of(run_in_parts(in_thirds(frames(spark, sf_dir)), lambda rows: frame_loop(rows, SETTINGS), "frame-rows"), "row")


@query()
def live_takeovers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections with no ids: the tracker gives them, and lost tracks are taken over where path and look agree."""
    settings = SETTINGS._replace(tracker={"start": 0.5, "lost": 30, "fps": 0.5}, limits=Limits(gap=60.0, pixel_speed=1.0), after=None)
    rows = frames(spark, sf_dir).drop("track_id").where("not flagged")
    return rows_of(run_in_parts(in_thirds(rows), lambda rows: frame_loop(rows, settings), "takeovers"), "rescue")


def _store(spark: SparkSession) -> Folder:
    return Folder(f"{shared_dir(spark)}/answers-{uuid.uuid4().hex}")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS key, c_custkey % 2 = 1 OR c_custkey % 7 = 0 AS asked, CASE WHEN c_custkey % 2 = 1 OR c_custkey % 7 = 0 THEN 'second ' ELSE 'first ' END || c_custkey AS body FROM customer""")
def asked_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second job asks for what the first did not, and again for what must not come from the store."""
    key = F.col("c_custkey").cast("string").alias("key")
    own = read(spark, sf_dir, "customer").select(key, (F.col("c_custkey") % 7 != 0).alias("allow_cache"))
    store = _store(spark)
    answered(own.where("key % 2 = 0"), lambda rows: [f"first {k}" for k in rows["key"]], store)
    twice = own.unionByName(own.withColumn("allow_cache", F.lit(True)))
    return answered(twice, lambda rows: [f"second {k}" for k in rows["key"]], store)


def plates(rows: pd.DataFrame) -> list[str]:
    """A service by rule: a user for each cell, but in composites of several none where the digest's first byte is a
    multiple of five."""
    out = []
    for cells in rows["cells"]:
        users = []
        for c in cells:
            first = int(c["image_sha256"][:2], 16)
            if len(cells) == 1 or first % 5:
                p = c["placed"]
                users.append({"x1": p["x1"], "y1": p["y1"], "x2": (p["x1"] + p["x2"]) / 2, "y2": p["y2"], "confidence": 0.9, "make": f"make {first % 16}", "make_confidence": first / 256, "model": f"model {first}", "model_confidence": 0.5})
        out.append(json.dumps(users))
    return out


@query("""WITH p AS (SELECT *, p_size % 3 AS run, sha256(CAST(p_partkey AS VARCHAR)) AS sha FROM part),
o AS (SELECT *, (row_number() OVER (PARTITION BY run ORDER BY p_partkey) - 1) // 16 AS chunk, CAST('0x' || substr(sha, 1, 2) AS INTEGER) AS b FROM p WHERE p_size % 4 <> 0),
n AS (SELECT *, count(*) OVER (PARTITION BY run, chunk) AS n FROM o)
SELECT CAST(run AS VARCHAR) AS run_id, p_partkey AS crop_id, CASE WHEN b % 5 = 0 AND n > 1 THEN 'single' ELSE 'batch' END AS via, true AS asked, 'make ' || (b % 16) AS make, b / 256.0::DOUBLE >= 0.5 AS accepted, round((40 + p_partkey % 60) / 2.0::DOUBLE, 6) AS found_x2 FROM n
UNION ALL SELECT CAST(run AS VARCHAR), p_partkey, 'record', false, 'known', true, NULL FROM p WHERE p_size % 4 = 0""")
def recognized_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    own = part.select((F.col("p_size") % 3).cast("string").alias("run_id"), key.alias("crop_id"), F.sha2(key.cast("string"), 256).alias("image_sha256"), (40 + key % 60).cast("double").alias("width"), F.lit(40.0).alias("height"), "p_size")
    none = lambda kind: F.lit(None).cast(kind)
    known = F.struct(F.lit("known").alias("make"), F.lit(0.9).alias("make_confidence"), F.lit("m").alias("model"), F.lit(0.9).alias("model_confidence"), none("struct<x1:double,y1:double,x2:double,y2:double>").alias("detection_box"), none("double").alias("detection_confidence"), F.lit("human").alias("evidence_source"), F.lit("retrieval").alias("resolution_method"))
    lookups = own.select("run_id", "crop_id", F.when(F.col("p_size") % 4 == 0, known).alias("result"), F.when(F.col("p_size") % 4 == 0, "exact_match").otherwise("no_match").alias("reason"))
    out = recognized(own.drop("p_size"), lookups, plates, _store(spark))
    return out.select("run_id", "crop_id", "via", "asked", "result.make", "accepted", r6(F.col("result.detection_box.x2")).alias("found_x2"))


@query("""SELECT CAST(p_size % 3 AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY p_size % 3 ORDER BY p_partkey) - 1 AS frame_index, round((row_number() OVER (PARTITION BY p_size % 3 ORDER BY p_partkey) - 1) / 12.5::DOUBLE, 6) AS t, p_name AS name FROM part
QUALIFY frame_index >= 100""")
def video_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of frames that hold the names of parts, read again from the hundredth frame on."""
    mark = lambda b: F.unhex(F.lit(b))
    part = read(spark, sf_dir, "part").select((F.col("p_size") % 3).cast("string").alias("run_id"), F.col("p_partkey").alias("frame_index"), F.concat(mark("FFD8"), F.col("p_name").cast("binary"), mark("FFD9")).alias("content"))
    files = write_frames(part, f"{shared_dir(spark)}/video-{uuid.uuid4().hex}", 12.5, 64, 48).collect()  # a row a run
    frames = read_frames(spark, [r["path"] for r in files]).where("frame_index >= 100")
    name = F.expr("substring(content, 3, length(content) - 4)").cast("string")
    return frames.select(F.regexp_extract("path", r"([^/]*)\.avi$", 1).alias("run_id"), "frame_index", r6("t").alias("t"), name.alias("name"))
