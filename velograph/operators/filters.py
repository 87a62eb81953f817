"""Row filters over detections and observations (P1-P16).

An observation is a row of (run_id, track_id, frame_index, pos, t, bbox, confidence, class_id, class_name); ``pos`` is
its place in the frame.  Every partitioning below starts with run_id.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograph.functions import boxes
from velograph.functions.geometry import Polygon, bounding_box, in_polygon, touches_polygon_edge


def class_filter(rows: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Rows whose class name is allowed, in any case; an empty list allows all."""
    return rows.where(F.lower("class_name").isin([a.lower() for a in allowed])) if allowed else rows


def class_names(rows: DataFrame, names: dict[int, str]) -> DataFrame:
    """Missing class names by class_id, "" where that has none either."""
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))]) if names else None
    by_id = F.element_at(known, F.col("class_id")) if names else F.lit(None).cast("string")
    return rows.withColumn("class_name", F.coalesce(F.nullif("class_name", F.lit("")), by_id, F.lit("")))


def clip_to_frame(rows: DataFrame, width: int, height: int) -> DataFrame:
    return rows.withColumn("bbox", boxes.clipped(F.col("bbox"), width, height)).where("bbox is not null")


def with_defaults(rows: DataFrame) -> DataFrame:
    """Missing confidences as 0 and missing track ids as -1."""
    return rows.withColumns({"confidence": F.coalesce("confidence", F.lit(0.0)), "track_id": F.coalesce("track_id", F.lit(-1))})


def inside_roi(rows: DataFrame, polygon: Polygon) -> DataFrame:
    foot = boxes.bottom_center(F.col("bbox"))
    return rows.withColumn("inside_roi", in_polygon(foot["x"], foot["y"], polygon))


def edge_flag(b: Column, width: int, height: int, polygon: Polygon, margin: int = 0, enabled: bool = True) -> Column:
    """Whether a box touches the edge of the frame, of the polygon's rectangle or of the polygon."""
    if not enabled:
        return F.lit(False)
    return boxes.touches_frame_edge(b, 0, 0, width, height, margin) | boxes.touches_frame_edge(b, *bounding_box(polygon), margin) | touches_polygon_edge(b, polygon, margin)


#: Boxes of a frame, side by side, that meet flagged ones at once, and flagged ones that they meet at once.
STRIP, MEETING = 512, 256
CORNERS = ("x1", "y1", "x2", "y2")


def _beside(b: np.ndarray, flagged: np.ndarray, least_iou: float) -> np.ndarray:
    """Which boxes overlap a flagged one by ``least_iou``, by the arithmetic of ``boxes.iou``."""
    area = lambda x: np.maximum(x[:, 2] - x[:, 0], 0.0) * np.maximum(x[:, 3] - x[:, 1], 0.0)
    size, of_flagged, near = area(b), area(flagged), np.zeros(len(b), bool)
    along = np.argsort(b[:, 0], kind="stable")
    for low in range(0, len(b), STRIP):
        open_ = along[low : low + STRIP]
        met = np.arange(len(flagged))
        if least_iou > 0:  # boxes apart share nothing
            left, top, right, bottom = b[open_, 0].min(), b[open_, 1].min(), b[open_, 2].max(), b[open_, 3].max()
            met = np.flatnonzero((flagged[:, 0] < right) & (flagged[:, 2] > left) & (flagged[:, 1] < bottom) & (flagged[:, 3] > top))
        for at in range(0, len(met), MEETING):
            o = met[at : at + MEETING]
            x = np.minimum(b[open_, None, 2], flagged[None, o, 2]) - np.maximum(b[open_, None, 0], flagged[None, o, 0])
            y = np.minimum(b[open_, None, 3], flagged[None, o, 3]) - np.maximum(b[open_, None, 1], flagged[None, o, 1])
            shared = np.maximum(x, 0.0) * np.maximum(y, 0.0)
            union = size[open_, None] + of_flagged[None, o] - shared
            hit = (np.divide(shared, union, out=np.zeros_like(shared), where=union > 0) >= least_iou).any(axis=1)
            near[open_[hit]] = True
            open_ = open_[~hit]
            if not len(open_):
                break
    return near


def drop_edge_observations(rows: DataFrame, flagged: DataFrame, is_edge: Column, least_iou: float = 0.5) -> DataFrame:
    """Observations of real tracks that neither touch an edge nor overlap a flagged detection (run_id, frame_index, bbox)
    of their frame.

    The distinct boxes of a frame meet its flagged ones in one group, only those beside them and no more once one overlaps.
    Boxes with a missing or boundless corner, if any, are compared as columns instead.
    """
    keys = ["run_id", "frame_index"]
    plain = F.lit(True)
    for c in CORNERS:
        plain &= F.coalesce(F.abs(F.col(f"bbox.{c}")) < 1e150, F.lit(False))  # not so for NaN, which is the largest number
    flat = lambda side: side.where(plain).dropna(subset=keys).select(*keys, *[F.col(f"bbox.{c}").cast("double").alias(c) for c in CORNERS]).distinct()

    def run(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        return own[_beside(own[list(CORNERS)].to_numpy(float), others[list(CORNERS)].to_numpy(float), least_iou)] if len(own) and len(others) else own.iloc[:0]

    def apart(rows: DataFrame, flagged: DataFrame) -> DataFrame:
        boxes_of = flagged.groupBy(*keys).agg(F.collect_list("bbox").alias("_edges"))
        near = F.exists("_edges", lambda e: boxes.iou(F.col("bbox"), e) >= least_iou)
        return rows.join(boxes_of, keys, "left").where(~F.coalesce(near, F.lit(False))).drop("_edges")

    real = rows.where((F.col("track_id") >= 0) & ~is_edge)
    ours = flat(real)
    kinds = ", ".join(f"`{c}` {ours.schema[c].dataType.simpleString()}" for c in ours.columns)
    gone = ours.groupBy(*keys).cogroup(flat(flagged).groupBy(*keys)).applyInPandas(run, kinds)
    gone = gone.select(*[F.col(c).alias(f"_{c}") for c in gone.columns])
    same = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col(f"bbox.{c}").cast("double") == F.col(f"_{c}") for c in CORNERS]
    return apart(real.where(plain).join(gone, same, "left_anti"), flagged.where(~plain)).unionByName(apart(real.where(~plain), flagged))


def size_gate(b: Column, width: float = 112, height: float = 56) -> Column:
    return (boxes.width(b) >= width) & (boxes.height(b) >= height)


def size_eligible(max_width: Column, max_height: Column, width: float = 112, height: float = 56) -> Column:
    """Of a track's largest box; an unknown height passes."""
    return (max_width >= width) & (max_height.isNull() | (max_height >= height))


def min_lifetime(summaries: DataFrame, frames: int) -> DataFrame:
    return summaries.where(F.col("frames_seen") >= frames) if frames > 0 else summaries


def visible_tracks(rows: DataFrame, summaries: DataFrame, frames: int, *, need_vehicle: bool = True, width: float = 112, height: float = 56) -> DataFrame:
    """(run_id, track_id) seen often enough, with a vehicle if needed, and large enough where summaries say so."""
    seen = rows.groupBy("run_id", "track_id").agg(F.count("*").alias("_n"), F.max("vehicle_index").alias("_v"))
    seen = seen.where((F.col("_n") >= frames) & (F.col("_v").isNotNull() | F.lit(not need_vehicle)))
    small = summaries.where(~size_eligible(F.col("max_width"), F.col("max_height"), width, height))
    return seen.join(small, ["run_id", "track_id"], "left_anti").select("run_id", "track_id")


def accepted(make: Column, model: Column, make_confidence: Column, least: float) -> Column:
    """Make and model are there and the make is sure enough."""
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return (F.coalesce(make_confidence, F.lit(0.0)) >= least) & filled(make) & filled(model)


def evidence_eligible(label_accepted: Column, make: Column, model: Column, make_confidence: Column, by_human: Column, least: float) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return F.coalesce(label_accepted, F.lit(False)) & filled(make) & filled(model) & (F.coalesce(by_human, F.lit(False)) | (F.coalesce(make_confidence, F.lit(0.0)) >= least))


def crop_columns(rows: DataFrame, width: int, height: int) -> DataFrame:
    """The padded crop of each box, its least distance to the frame's edge, and its area."""
    crop = boxes.padded(F.col("bbox"), width, height)
    edge = F.least(F.col("crop.x1"), F.col("crop.y1"), F.lit(float(width)) - F.col("crop.x2"), F.lit(float(height)) - F.col("crop.y2"))
    return rows.withColumn("crop", crop).withColumns({"edge_margin": edge, "area": boxes.area(F.col("bbox"))})
