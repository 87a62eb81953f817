"""The driver's tables in the shapes of this engine.

``events`` stand for observations: a user is a track, an hour is a second, and boxes come from integers of the ids, so
that any engine computes the same.  The SQL of the same shapes is kept beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velograph.functions import boxes

ZONE = ((100.0, 80.0), (700.0, 60.0), (760.0, 420.0), (380.0, 560.0), (60.0, 400.0))
LINE = ((0.0, 300.0), (1000.0, 300.0))
WIDTH, HEIGHT = 1000, 640
#: Hours without an event after which a user's events are another fragment.
FRAGMENT = 24.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str, runs: int | None = None) -> DataFrame:
    """run_id, track_id, frame_index, pos, t, bbox, class_name, confidence, vehicle_index, value, props.

    All are one run, or with ``runs`` a track is in the run of its remainder.
    """
    e = read(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    x, y = (u * 137 + i * 3) % 800, (u * 71 + i * 5) % 500
    b = boxes.box(x, y, x + 60 + (i * 7) % 200, y + 40 + (i * 11) % 120)
    t = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts").cast("timestamp_ntz")) / F.lit(3.6e9)
    return e.select(
        (F.lit("r") if runs is None else (u % runs).cast("string")).alias("run_id"), u.alias("track_id"), F.floor(t * 10).alias("frame_index"), i.alias("pos"), t.alias("t"), b.alias("bbox"), F.col("event_type").alias("class_name"),
        ((i % 100) / 100.0).alias("confidence"), F.when(u % 3 != 0, u % 50).alias("vehicle_index"), "value", "props",
    )


OBSERVATIONS = """obs AS (
  SELECT user_id AS track_id, CAST(floor(epoch_us(ts) / 3.6e9 * 10) AS BIGINT) AS frame_index, event_id AS pos, epoch_us(ts) / 3.6e9 AS t,
    CAST((user_id * 137 + event_id * 3) % 800 AS DOUBLE) AS x1, CAST((user_id * 71 + event_id * 5) % 500 AS DOUBLE) AS y1,
    CAST((user_id * 137 + event_id * 3) % 800 + 60 + (event_id * 7) % 200 AS DOUBLE) AS x2, CAST((user_id * 71 + event_id * 5) % 500 + 40 + (event_id * 11) % 120 AS DOUBLE) AS y2,
    event_type AS class_name, CAST((event_id % 100) AS DOUBLE) / 100 AS confidence, CASE WHEN user_id % 3 <> 0 THEN user_id % 50 END AS vehicle_index, value, props
  FROM events),
feet AS (SELECT *, (x1 + x2) / 2 AS fx, y2 AS fy, x2 - x1 AS w, y2 - y1 AS h FROM obs)"""


def fragments(rows: DataFrame) -> DataFrame:
    """Observations with track_id of the fragment (user * 1000 + number) and user as vehicle_index of every other one."""
    w = Window.partitionBy("run_id", "track_id").orderBy("frame_index", "pos")
    new = F.coalesce((F.col("t") - F.lag("t").over(w) > FRAGMENT).cast("int"), F.lit(0))
    cut = rows.withColumn("_new", new).withColumn("_f", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = F.col("track_id") * 1000 + F.col("_f")
    return cut.withColumn("vehicle_index", F.when(F.col("_f") % 2 == 0, F.col("track_id"))).withColumn("track_id", own).drop("_new", "_f")


FRAGMENTS = f"""cut AS (
  SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY track_id ORDER BY frame_index, pos) > {FRAGMENT} THEN 1 ELSE 0 END AS is_new FROM feet),
frag AS (
  SELECT * REPLACE (track_id * 1000 + f AS track_id, CASE WHEN f % 2 = 0 THEN track_id END AS vehicle_index) FROM (
    SELECT *, CAST(sum(is_new) OVER (PARTITION BY track_id ORDER BY frame_index, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS f FROM cut))"""


def polygon_sql(x: str, y: str, polygon=ZONE) -> str:
    """Inside or on the boundary, as SQL over literal edges."""
    cross, touch = [], []
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        touch.append(f"(({x} - {ax}::DOUBLE) * {by - ay}::DOUBLE - ({y} - {ay}::DOUBLE) * {bx - ax}::DOUBLE = 0 AND {x} BETWEEN {min(ax, bx)} AND {max(ax, bx)} AND {y} BETWEEN {min(ay, by)} AND {max(ay, by)})")
        if ay != by:
            cross.append(f"CASE WHEN ({y} < {ay}) <> ({y} < {by}) AND {x} < ({y} - {ay}::DOUBLE) * ({bx - ax}::DOUBLE / {by - ay}::DOUBLE) + {ax}::DOUBLE THEN 1 ELSE 0 END")
    return f"({' OR '.join(touch)} OR ({' + '.join(cross)}) % 2 = 1)"


def edge_sql(polygon=ZONE) -> str:
    """Whether the box x1, y1, x2, y2, in whole pixels, meets an edge, or a corner of the box itself is outside."""
    tests = []
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        begins, ends, fixed = ["0"], ["1"], []
        for low, high, p, q in (("floor(x1)", "ceil(x2)", ax, bx), ("floor(y1)", "ceil(y2)", ay, by)):
            if p == q:
                fixed.append(f"{p} BETWEEN {low} AND {high}")
            else:
                first, last = (f"({side} - {p}::DOUBLE) / {q - p}::DOUBLE" for side in ((low, high) if q > p else (high, low)))
                begins.append(first)
                ends.append(last)
        tests.append("(" + " AND ".join([f"greatest({', '.join(begins)}) <= least({', '.join(ends)})", *fixed]) + ")")
    tests += [f"NOT {polygon_sql(x, y, polygon)}" for x in ("x1", "x2") for y in ("y1", "y2")]
    return f"({' OR '.join(tests)})"
