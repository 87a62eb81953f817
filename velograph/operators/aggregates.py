"""Aggregates over tracks, vehicles and labels."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograph.operators.joins import numbered


def histogram(rows: DataFrame, value: Column, edges: Sequence[float]) -> DataFrame:
    """(bin, low, high, n) of half-open bins, the last one closed unless its end is infinite (then ``high`` is null);
    values outside and nulls are left out, empty bins are kept."""
    last = len(edges) - 2
    found = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        low, high = float(edges[i]), float(edges[i + 1])
        found = F.when((value >= low) & ((value <= high) if i == last else (value < high)), i).otherwise(found)
    counts = rows.select(found.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("n"))
    bins = rows.sparkSession.createDataFrame([(i, float(edges[i]), None if edges[i + 1] == float("inf") else float(edges[i + 1])) for i in range(last + 1)], "bin int, low double, high double")
    return bins.join(counts, "bin", "left").select("bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))


def conditional_counts(summaries: DataFrame, *, width: float = 112, height: float = 56, frames: int = 0) -> DataFrame:
    """One row: tracks, those without crops, and why."""
    none = F.size("candidates") == 0
    return summaries.agg(
        F.count("*").alias("tracks"), F.count_if(none).alias("without_crops"), F.count_if(none & (F.col("max_width") < width)).alias("too_narrow"),
        F.count_if(none & (F.col("max_height") < height)).alias("too_low"), F.count_if(F.col("frames_seen") < frames).alias("too_short"),
    )


def distinct_vehicles(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count_distinct("vehicle_index").alias("vehicles"))


def vehicles_of_tracks(summaries: DataFrame) -> DataFrame:
    """A row a vehicle: its tracks, frames seen in all, and the order of first appearance."""
    own = summaries.where("vehicle_index is not null").groupBy("run_id", "vehicle_index").agg(
        F.min("first_frame").alias("first_frame"), F.min("track_id").alias("least_track"), F.sum("frames_seen").alias("frames_seen"), F.array_sort(F.collect_list(F.struct("first_frame", "track_id"))).alias("tracks")
    )
    return numbered(own, ["run_id"], ["first_frame", "least_track"], "place")


def scale_error(width: Column, low: Column, high: Column, target: float = 0.75) -> Column:
    """How far a box is from the wanted place in its track's range of widths, as a share of the range."""
    span = high - low
    return F.when(span > 0, F.abs((width - low) / span - target)).otherwise(0.0)


def cleanliness(overlap: Column, clean: float = 0.10, fair: float = 0.50) -> Column:
    return F.when(overlap <= clean, 2).when(overlap <= fair, 1).otherwise(0)


def best_crop(candidates: DataFrame, *keys: str) -> DataFrame:
    """The best candidate of each key: cleanest, nearest to its track's wanted scale, sharpest, farthest from the edge,
    largest, earliest; the first one (``ord``) wins a tie."""
    rank = F.struct(
        cleanliness(F.col("overlap")).alias("tier"), (-scale_error(F.col("width"), F.col("min_width"), F.col("max_width"))).alias("scale"),
        "sharpness", "edge_margin", "area", (-F.col("frame_index")).alias("frame"), (-F.col("ord")).alias("first"),
    )
    whole = F.struct(*candidates.columns)
    return candidates.groupBy(*keys).agg(F.max_by(whole, rank).alias("best")).select("best.*")


def make_counts(rows: DataFrame, limit: int | None = 15) -> DataFrame:
    """(make, n, progress): vehicles by the make first seen on them, the commonest first, against the largest."""
    firsts = rows.where("make is not null and vehicle_index is not null").groupBy("run_id", "vehicle_index").agg(F.min_by("make", F.struct("frame_index", "pos")).alias("make"))
    counts = firsts.groupBy("make").agg(F.count("*").alias("n"))
    most = counts.agg(F.max("n").alias("most"))  # one row
    out = counts.join(F.broadcast(most)).select("make", "n", (F.col("n") / F.col("most")).alias("progress"))
    return out.orderBy(F.desc("n"), "make").limit(limit) if limit else out


#: Boxes of a frame, side by side, whose overlaps are added up at once, and boxes that they meet at once.
STRIP, MEETING = 512, 256


def _covered(pos: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How much of each box the others cover, added up; from 1 on not to the end."""
    size = np.clip(b[:, 2] - b[:, 0], 0, None) * np.clip(b[:, 3] - b[:, 1], 0, None)
    total = np.zeros(len(b))
    along = np.argsort(b[:, 0], kind="stable")
    anyhow = np.random.default_rng(len(b)).permutation(len(b))  # so that what covers a box comes early, wherever it lies
    for low in range(0, len(b), STRIP):
        open_ = along[low : low + STRIP]
        open_ = open_[size[open_] > 0]
        if not len(open_):
            continue
        left, top, right, bottom = b[open_, 0].min(), b[open_, 1].min(), b[open_, 2].max(), b[open_, 3].max()
        met = anyhow[(b[anyhow, 0] < right) & (b[anyhow, 2] > left) & (b[anyhow, 1] < bottom) & (b[anyhow, 3] > top)]
        for at in range(0, len(met), MEETING):
            o = met[at : at + MEETING]
            x = np.minimum(b[open_, None, 2], b[None, o, 2]) - np.maximum(b[open_, None, 0], b[None, o, 0])
            y = np.minimum(b[open_, None, 3], b[None, o, 3]) - np.maximum(b[open_, None, 1], b[None, o, 1])
            part = np.clip(x, 0, None) * np.clip(y, 0, None) / size[open_, None]
            total[open_] += np.where(pos[open_, None] == pos[None, o], 0.0, part).sum(axis=1)
            open_ = open_[total[open_] < 1]
            if not len(open_):
                break
    return total


def sibling_overlap(rows: DataFrame) -> DataFrame:
    """``rows`` with overlap: how much of the box other boxes of its frame cover, added up, 1 at most.

    A frame is one group, of which boxes meet only those beside them, and no more once they are covered, so the work does
    not grow with the square of a crowded frame.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        total = _covered(frame["pos"].to_numpy(), frame[["x1", "y1", "x2", "y2"]].to_numpy(float))
        return frame[["run_id", "frame_index", "pos"]].assign(overlap=total).groupby(["run_id", "frame_index", "pos"], as_index=False).sum()

    keys = ["run_id", "frame_index", "pos"]
    flat = rows.dropna(subset=keys).select(*keys, *[F.coalesce(F.col(f"bbox.{c}").cast("double"), F.lit(0.0)).alias(c) for c in ("x1", "y1", "x2", "y2")])
    kinds = ", ".join(f"{k} {flat.schema[k].dataType.simpleString()}" for k in keys)
    total = flat.groupBy("run_id", "frame_index").applyInPandas(run, f"{kinds}, overlap double").withColumn("overlap", F.least(F.lit(1.0), "overlap"))
    return rows.join(total, keys)


def chunks(rows: DataFrame, size: int, *order: str) -> DataFrame:
    """``chunk`` numbers of ``size`` rows within each run, in order, which leaves no ties open."""
    return numbered(rows, ["run_id"], list(order), "chunk").withColumn("chunk", F.floor((F.col("chunk") - 1) / size).cast("int"))


#: Bounds of the histograms of confidences and of box widths.
CONFIDENCES = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01]
WIDTHS = [0.0, 40.0, 80.0, 120.0, 160.0, 200.0, 300.0, 400.0, 600.0, 800.0, float("inf")]


def diagnostics(
    frames: DataFrame, detections: DataFrame, outputs: DataFrame, summaries: DataFrame, retired: DataFrame, *, frames_needed: int, width: float = 112, height: float = 56,
    edges: DataFrame | None = None, retained: DataFrame | None = None, hidden: DataFrame | None = None,
) -> DataFrame:
    """One row about an analysis: what went into the tracker and came out of it, and why tracks have no crops.

    ``frames`` are those sampled, ``detections`` those given to the tracker, ``outputs`` the tracked rows (track_id below
    0: not confirmed; confidence and bbox), ``summaries`` the tracks with frames_seen, max_width, max_height and candidates,
    ``retired`` the rows (track_id) of ids that came back after they were given up, ``edges`` the rows (track_id) skipped at an
    edge, ``retained`` the rows (track_id) after a long gap that were plausible, and ``hidden`` the tracks that are not drawn
    for want of a crop.  Histograms are arrays of (min, max, count) in order; the confidences are those of all outputs, the
    widths those of outputs of tracks that are neither retired nor skipped (column ``stays``, if there is one).
    """
    none = F.size("candidates") == 0
    count = lambda rows, *columns: rows.agg(*columns)
    nothing = outputs.where(F.lit(False)).select("track_id")
    edges, retained, hidden = edges or nothing, retained or nothing, hidden or nothing
    kept = outputs.where(F.col("stays") if "stays" in outputs.columns else F.col("track_id") >= 0)
    parts = [
        count(frames, F.count("*").alias("total_sampled_frames")),
        count(detections, F.count("*").alias("detections_passed_to_tracker")),
        count(outputs, F.count_if(F.col("track_id") >= 0).alias("tracker_outputs")),
        count(
            summaries, F.count_if(F.col("frames_seen") < frames_needed).alias("tracks_discarded_min_track_frames"), F.count_if(none).alias("tracks_without_crop_candidates"),
            F.count_if(none & (F.col("max_width") < width)).alias("tracks_without_crop_due_to_width"), F.count_if(none & (F.col("max_height") < height)).alias("tracks_without_crop_due_to_height"),
            F.count_if(none & (F.col("frames_seen") < frames_needed)).alias("tracks_without_crop_due_to_short_lifetime"),
        ),
        count(retired, F.count("*").alias("stale_reassociation_observations_suppressed"), F.count_distinct("track_id").alias("stale_reassociation_track_ids_dropped")),
        count(edges, F.count("*").alias("edge_observations_skipped"), F.count_if(F.col("track_id") >= 0).alias("tracks_discarded_edge_contact")),
        count(retained, F.count("*").alias("world_reassociation_observations_accepted"), F.count_distinct("track_id").alias("world_reassociation_tracks_retained")),
        count(hidden, F.count("*").alias("tracks_hidden_from_render_crop_eligibility")),
        _in_order(histogram(outputs, F.col("confidence"), CONFIDENCES), "confidence_histogram"),
        _in_order(histogram(kept, F.col("bbox.x2") - F.col("bbox.x1"), WIDTHS), "box_width_histogram"),
    ]
    out = parts[0]
    for other in parts[1:]:
        out = out.join(F.broadcast(other))  # one row each
    return out


def _in_order(bins: DataFrame, name: str) -> DataFrame:
    """The rows of a histogram as one array; an infinite bound is null."""
    rows = F.array_sort(F.collect_list(F.struct("bin", F.col("low").alias("min"), F.col("high").alias("max"), F.col("n").alias("count"))))
    return bins.agg(F.transform(rows, lambda b: b.dropFields("bin")).alias(name))
