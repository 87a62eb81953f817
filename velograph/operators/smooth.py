"""Smoothing, interpolation and filling of tracks for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velograph.functions import boxes
from velograph.operators.joins import between_neighbours
from velograph.operators.tracks import KEYS, ORDER, segments


def record_positions(frames: DataFrame) -> DataFrame:
    """``position`` of each analysed frame in its run, from 0; empty frames count."""
    return frames.withColumn("position", F.row_number().over(Window.partitionBy("run_id").orderBy("frame_index")) - 1)


def fitted_boxes(rows: DataFrame, window: int = 5, clamp: float = 0.10, least: float = 1.0) -> DataFrame:
    """``rows`` (with position) with ``smooth``: per segment, straight lines through center and size of the ``window``
    rows around each, moved inwards at the ends; no value is more than ``clamp`` of the size off the seen one.

    Each row sees the 2 * window - 1 rows around it, which hold its window wherever that is moved; one sort does for all.
    """
    size = F.count("*").over(Window.partitionBy(*KEYS, "segment"))
    w = Window.partitionBy(*KEYS, "segment").orderBy(*ORDER)
    b = F.col("bbox")
    seg = segments(rows, F.col("position")).withColumns({"_i": F.row_number().over(w) - 1, "_n": size})
    span = F.least(F.col("_n"), F.lit(window))
    first = F.least(F.greatest(F.col("_i") - F.floor(span / 2), F.lit(0)), F.col("_n") - span).cast("int")
    values = {"cx": boxes.center(b)["x"], "cy": boxes.center(b)["y"], "w": boxes.width(b), "h": boxes.height(b)}
    # rows from -(window-1) to window-1 hold every clamped window
    near = F.collect_list(F.struct(F.col("_i").alias("i"), F.col("frame_index").cast("double").alias("f"), *[v.alias(k) for k, v in values.items()])).over(w.rowsBetween(-(window - 1), window - 1))
    own = seg.withColumns({"_first": first, "_span": span, "_near": near}).withColumn("_w", F.filter("_near", lambda p: (p["i"] >= F.col("_first")) & (p["i"] < F.col("_first") + F.col("_span"))))

    def line(k: str) -> Column:
        raw, at = values[k], F.col("frame_index").cast("double")
        total = lambda g: F.aggregate(F.transform("_w", g), F.lit(0.0), lambda s, x: s + x)
        n = F.size("_w").cast("double")
        mf, mv = total(lambda p: p["f"]) / n, total(lambda p: p[k]) / n
        sxx = total(lambda p: (p["f"] - mf) * (p["f"] - mf))
        sxy = total(lambda p: (p["f"] - mf) * (p[k] - mv))
        return F.when((F.size("_w") >= 2) & (sxx > 0), mv + sxy / sxx * (at - mf)).otherwise(raw)

    def held(k: str, by: Column) -> Column:
        return F.least(F.greatest(line(k), values[k] - by * clamp), values[k] + by * clamp)

    smooth = boxes.from_center(held("cx", values["w"]), held("cy", values["h"]), held("w", values["w"]), held("h", values["h"]), least)
    return own.withColumn("smooth", smooth).drop("_i", "_n", "_first", "_span", "_near", "_w", "segment")


def moving_average(rows: DataFrame, length: int = 5) -> DataFrame:
    """``rows`` (with position) with ``smooth``: the mean box of a track's last ``length`` rows without a missing one."""
    seg = segments(rows, F.col("position"), most=0)
    w = Window.partitionBy(*KEYS, "segment").orderBy(*ORDER).rowsBetween(-(length - 1), 0)
    mean = lambda c: F.avg(f"bbox.{c}").over(w)
    return seg.withColumn("smooth", boxes.box(mean("x1"), mean("y1"), mean("x2"), mean("y2"))).drop("segment")


def _mixed(ratio: Column, prev: str, following: str) -> Column:
    mix = lambda c: F.col(f"{prev}.bbox.{c}") + (F.col(f"{following}.bbox.{c}") - F.col(f"{prev}.bbox.{c}")) * ratio
    return boxes.box(mix("x1"), mix("y1"), mix("x2"), mix("y2"))


def bridge_gaps(rows: DataFrame, frames: DataFrame, most: int = 15) -> DataFrame:
    """Rows for the 1 to ``most`` record positions that a track misses between two of its own.

    ``rows`` and ``frames`` have position.  Boxes and confidence lie between the neighbours by time; vehicle and class
    are the earlier row's, else the later's; counted if either is; never a crossing.
    """
    carried = [c for c in rows.columns if c not in ("run_id", "track_id", "position")]
    gaps = between_neighbours(rows, "position", list(KEYS), list(ORDER), most, carried)
    at = gaps.join(frames.select("run_id", "position", F.col("frame_index").alias("_f"), F.col("t").alias("_t")), ["run_id", "position"])
    span = F.col("next.t") - F.col("prev.t")
    ratio = F.when(span > 0, F.least(F.greatest((F.col("_t") - F.col("prev.t")) / span, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return at.select(*[_between(c, ratio, rows) for c in rows.columns])


def _between(c: str, ratio: Column, rows: DataFrame) -> Column:
    if c in ("run_id", "track_id", "position"):
        return F.col(c)
    if c in ("frame_index", "t"):
        return F.col("_f" if c == "frame_index" else "_t").alias(c)
    if c == "bbox":
        return _mixed(ratio, "prev", "next").alias(c)
    if c == "confidence":
        return (F.col("prev.confidence") + (F.col("next.confidence") - F.col("prev.confidence")) * ratio).alias(c)
    if c == "counted":
        return (F.col("prev.counted") | F.col("next.counted")).alias(c)
    if c == "crossed_line":
        return F.lit(False).alias(c)
    return F.coalesce(f"prev.{c}", f"next.{c}").alias(c)


def interpolate_frames(rows: DataFrame, frames: DataFrame, fps: float, max_gap: float | None = 0.25, min_fps: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, clears): rows of video frames strictly between neighbouring analysed frames, for tracks in both, and
    (run_id, frame_index) of empty frames to show after an analysed frame where the gap is too long or no track goes on.

    ``frames`` (run_id, frame_index, t) are those analysed.  ``max_gap`` None stands for 1.5 frames at ``min_fps``.
    """
    rows = rows.drop("position")
    limit = max_gap if max_gap is not None else 1.5 / (min_fps or fps)
    w = Window.partitionBy("run_id").orderBy("frame_index")
    step = frames.select("run_id", "frame_index", "t", F.lead("frame_index").over(w).alias("nf"), F.lead("t").over(w).alias("nt"))
    step = step.where((F.col("nf") - F.col("frame_index") > 1) & (F.col("nt") - F.col("t") > 0))
    columns = [c for c in rows.columns if c not in KEYS]
    prev = rows.select(*KEYS, F.struct(*columns).alias("prev"), "frame_index")
    after = rows.select(*KEYS, F.struct(*columns).alias("next"), F.col("frame_index").alias("nf"))
    both = step.join(prev, ["run_id", "frame_index"]).join(after, ["run_id", "track_id", "nf"])
    short = F.col("nt") - F.col("t") <= limit
    spread = both.where(short).withColumn("_f", F.explode(F.sequence(F.col("frame_index") + 1, F.col("nf") - 1))).withColumn("_t", F.col("_f") / fps)
    ratio = F.least(F.greatest((F.col("_t") - F.col("t")) / (F.col("nt") - F.col("t")), F.lit(0.0)), F.lit(1.0))
    made = spread.select(*[F.col(c) if c in KEYS else _between(c, ratio, rows) for c in rows.columns])
    going_on = both.where(short).select("run_id", "frame_index").distinct()
    clears = step.join(going_on, ["run_id", "frame_index"], "left_anti").select("run_id", (F.col("frame_index") + 1).alias("frame_index"))
    return made, clears


def smoothed(rows: DataFrame, frames: DataFrame, *, observed: bool = True, bridged: bool = True, window: int = 5, most: int = 15) -> DataFrame:
    """Observed rows with fitted boxes, and rows for the gaps between them, as wanted."""
    placed = rows.join(record_positions(frames).select("run_id", "frame_index", "position"), ["run_id", "frame_index"]).select(*rows.columns, "position")
    if observed:
        placed = fitted_boxes(placed, window).withColumn("bbox", F.col("smooth")).select(placed.columns)
    if bridged:
        placed = placed.unionByName(bridge_gaps(placed, record_positions(frames), most))
    return placed


