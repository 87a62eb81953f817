"""What holds along a track: windows in the order of (frame_index, pos), partitioned by run and track."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velograph.functions import boxes
from velograph.functions.geometry import side_of_line
from velograph.operators.joins import numbered

KEYS = ("run_id", "track_id")
ORDER = ("frame_index", "pos")


def along(*keys: str):
    return Window.partitionBy(*(keys or KEYS)).orderBy(*ORDER)


def so_far(window=None):
    return (window or along()).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def track_metrics(rows: DataFrame) -> DataFrame:
    """(run_id, track_id, frames_seen, first_frame, last_frame, min/max width and height)."""
    b = F.col("bbox")
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("frames_seen"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"),
        F.min(boxes.width(b)).alias("min_width"), F.max(boxes.width(b)).alias("max_width"), F.min(boxes.height(b)).alias("min_height"), F.max(boxes.height(b)).alias("max_height"),
    )


def steps(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """``rows`` with gap and distance to the observation before; null for a track's first."""
    w = along()
    placed = rows.withColumns({"_x": x, "_y": y})
    return placed.withColumns({"gap": F.col("t") - F.lag("t").over(w), "dist": F.hypot(F.col("_x") - F.lag("_x").over(w), F.col("_y") - F.lag("_y").over(w))}).drop("_x", "_y")


def speeds(rows: DataFrame, x: Column, y: Column) -> DataFrame:
    """(run_id, track_id, median, max) of distance over time between neighbours; no row for tracks without a step."""
    moved = steps(rows, x, y).where((F.col("gap") > 0) & ~F.isnan("dist") & (F.col("dist") < float("inf"))).withColumn("v", F.col("dist") / F.col("gap"))
    return moved.groupBy(*KEYS).agg(F.median("v").alias("speed_median"), F.max("v").alias("speed_max"))


def counted_in_zone(rows: DataFrame) -> DataFrame:
    """``counted`` from the first observation inside the zone on."""
    return rows.withColumn("counted", F.coalesce(F.bool_or("inside_roi").over(so_far()), F.lit(False)))


def line_crossings(rows: DataFrame, start: tuple[float, float], end: tuple[float, float], x: Column, y: Column) -> DataFrame:
    """``rows`` with crossing A_TO_B or B_TO_A where the side of the line changed since the last observation beside it.

    Observations beyond the ends of the line or on it have no side and keep the last one.  In image coordinates, with
    the line drawn from left to right, downwards is A_TO_B.
    """
    side = F.nullif(side_of_line(x, y, start, end), F.lit(0))
    sided = rows.withColumn("_side", side)
    before = F.last("_side", ignorenulls=True).over(along().rowsBetween(Window.unboundedPreceding, -1))
    flip = F.when(F.col("_side").isNotNull() & (F.col("_side") != F.col("_before")), F.when(F.col("_side") > 0, "A_TO_B").otherwise("B_TO_A"))
    return sided.withColumn("_before", before).withColumn("crossing", flip).drop("_side", "_before")


def first_crossing(rows: DataFrame, direction: str = "BOTH") -> DataFrame:
    """``crossed_line`` at a track's first allowed crossing inside the zone, ``counted`` from there on."""
    allowed = F.col("crossing").isNotNull() if direction == "BOTH" else F.coalesce(F.col("crossing") == direction, F.lit(False))
    good = F.coalesce(allowed & F.col("inside_roi"), F.lit(False))
    nth = F.sum(good.cast("int")).over(so_far())
    return rows.withColumn("_good", good).withColumn("_n", nth).withColumns({"crossed_line": F.col("_good") & (F.col("_n") == 1), "counted": F.col("_n") >= 1}).drop("_good", "_n")


def retire_stale(rows: DataFrame, x: Column, y: Column, *, after: float | None = 0.35, world_gap: float = 2.0, reach: float = 150.0, speed: float = 40.0) -> DataFrame:
    """Observations before their track's first implausible gap.

    A gap over ``after`` is plausible only up to ``world_gap`` and over a distance of ``min(reach, speed * gap)``.
    Negative ids pass, and ``after`` None turns the filter off.
    """
    if after is None:
        return rows
    bad = (F.col("gap") > after) & ~((F.col("gap") <= world_gap) & (F.col("dist") <= F.least(F.lit(reach), F.col("gap") * speed)))
    marked = steps(rows, x, y).withColumn("_gone", F.coalesce(F.bool_or(bad).over(so_far()), F.lit(False)))
    return marked.where((F.col("track_id") < 0) | ~F.col("_gone")).drop("gap", "dist", "_gone")


def endpoints(rows: DataFrame, x: Column, y: Column, recent: int = 3) -> DataFrame:
    """A row a track: first and last time and place, vehicle index (the last row's, else the first known), and velocity
    over the last ``recent`` observations (null for fewer than two or no time between them)."""
    placed = rows.select(*KEYS, *ORDER, "t", "vehicle_index", x.alias("x"), y.alias("y"))
    back = placed.withColumn("_back", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*[F.desc(c) for c in ORDER])))
    key = F.struct(*ORDER)
    tail = F.col("_back") <= recent
    ends = back.groupBy(*KEYS).agg(
        F.count("*").alias("frames_seen"), F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"),
        F.min_by(F.struct("t", "x", "y"), key).alias("first"), F.max_by(F.struct("t", "x", "y"), key).alias("last"),
        F.min_by(F.when(tail, F.struct("t", "x", "y")), F.when(tail, key)).alias("_from"),
        F.max_by("vehicle_index", key).alias("_v_last"), F.min_by(F.when(F.col("vehicle_index").isNotNull(), F.col("vehicle_index")), F.when(F.col("vehicle_index").isNotNull(), key)).alias("_v_first"),
    )
    span = F.col("last.t") - F.col("_from.t")
    speed = lambda c: F.when((span > 0), (F.col(f"last.{c}") - F.col(f"_from.{c}")) / span)
    return ends.withColumns({"vehicle_index": F.coalesce("_v_last", "_v_first"), "vx": speed("x"), "vy": speed("y")}).drop("_from", "_v_last", "_v_first")


def extrapolate(before: Column, last: Column, t: Column) -> Column:
    """The box at time ``t`` by the centers and sizes of two STRUCT<t, bbox>; the last box if there is only one."""
    b, a = before["bbox"], last["bbox"]
    span = last["t"] - before["t"]
    f = (t - last["t"]) / span
    cb, ca = boxes.center(b), boxes.center(a)
    go = lambda p, q: q + (q - p) * f
    out = boxes.from_center(go(cb["x"], ca["x"]), go(cb["y"], ca["y"]), go(boxes.width(b), boxes.width(a)), go(boxes.height(b), boxes.height(a)))
    return F.when(before.isNull() | (span <= 0), a).otherwise(out)


def fitted_velocity(rows: DataFrame, x: Column, y: Column, points: int = 5) -> DataFrame:
    """(run_id, track_id, vx, vy): least-squares slopes over the last points; null for fewer than two or no time."""
    last = rows.withColumn("_back", F.row_number().over(Window.partitionBy(*KEYS).orderBy(*[F.desc(c) for c in ORDER]))).where(F.col("_back") <= points)
    return last.withColumns({"_x": x, "_y": y}).groupBy(*KEYS).agg(F.regr_slope("_x", "t").alias("vx"), F.regr_slope("_y", "t").alias("vy"))


def number_vehicles(summaries: DataFrame) -> DataFrame:
    """``vehicle_index`` from 1 in the order of (first_frame, track_id) of each run, for tracks that have candidates."""
    marked = summaries.drop("vehicle_index").withColumn("_have", F.coalesce(F.size("candidates") > 0, F.lit(False)))
    nth = numbered(marked, ["run_id", "_have"], ["first_frame", "track_id"], "vehicle_index")
    return nth.withColumn("vehicle_index", F.when(F.col("_have"), F.col("vehicle_index"))).drop("_have")


def every_nth(rows: DataFrame, n: int) -> DataFrame:
    """A track's first observation and each n-th after it."""
    return rows.withColumn("_i", F.row_number().over(along()) - 1).where(F.col("_i") % n == 0).drop("_i")


def segments(rows: DataFrame, position: Column, most: int = 15) -> DataFrame:
    """``segment`` numbers that start anew where more than ``most`` positions are missing."""
    w = along()
    placed = rows.withColumn("_p", position)
    new = placed.withColumn("_new", F.coalesce((F.col("_p") - F.lag("_p").over(w) - 1 > most).cast("int"), F.lit(0)))
    return new.withColumn("segment", F.sum("_new").over(so_far())).drop("_p", "_new")


def first_in_frame(rows: DataFrame) -> DataFrame:
    """The first row of each vehicle in a frame; rows without a vehicle all stay."""
    nth = F.row_number().over(Window.partitionBy("run_id", "frame_index", "vehicle_index").orderBy("pos"))
    return rows.withColumn("_n", nth).where(F.col("vehicle_index").isNull() | (F.col("_n") == 1)).drop("_n")


def running_vehicles(rows: DataFrame, frames: DataFrame) -> DataFrame:
    """(run_id, frame_index, vehicles): distinct counted vehicles up to each frame.

    A vehicle counts once, at its first counted frame, so the running sum is over a row a frame.
    """
    firsts = rows.where("counted and vehicle_index is not null").groupBy("run_id", "vehicle_index").agg(F.min("frame_index").alias("frame_index"))
    new = firsts.groupBy("run_id", "frame_index").agg(F.count("*").alias("_n"))
    w = Window.partitionBy("run_id").orderBy("frame_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return frames.select("run_id", "frame_index").join(new, ["run_id", "frame_index"], "left").select("run_id", "frame_index", F.sum(F.coalesce("_n", F.lit(0))).over(w).alias("vehicles"))
