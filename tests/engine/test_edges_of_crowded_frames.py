"""Flagged detections in crowded frames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from velograph.functions import boxes
from velograph.operators import filters


def plain(rows, flagged, least):
    """Each row with all flagged boxes of its frame, as columns."""
    held = flagged.groupBy("run_id", "frame_index").agg(F.collect_list("bbox").alias("e"))
    near = F.exists("e", lambda e: boxes.iou(F.col("bbox"), e) >= least)
    return sorted(r.pos for r in rows.where("track_id >= 0").join(held, ["run_id", "frame_index"], "left").where(~F.coalesce(near, F.lit(False))).collect())


def test_crowded_frames_keep_the_same_rows_without_arrays_of_all_flagged(spark, monkeypatch):
    monkeypatch.setattr(filters, "STRIP", 16)
    monkeypatch.setattr(filters, "MEETING", 8)
    rng = np.random.default_rng(4)
    low = rng.integers(0, 60, (300, 2))
    b = np.hstack([low, low + rng.integers(0, 30, (300, 2))]).astype(float).tolist()
    nan = float("nan")
    b += [[None, 0.0, 10.0, 10.0], [0.0, nan, 10.0, 10.0], [0.0, 0.0, float("inf"), 10.0], [0.0, 0.0, 0.0, 0.0], [None] * 4]
    at = [("r", None if i % 50 == 7 else i % 3, i, i % 40 - 1, tuple(x)) for i, x in enumerate(b)]
    rows = spark.createDataFrame(at, "run_id string, frame_index long, pos long, track_id long, bbox struct<x1 double, y1 double, x2 double, y2 double>")
    for every in (9, 302):
        flagged = rows.where(F.col("pos") % every == 0)
        for least in (0.5, 0.2, 0.0):
            out = filters.drop_edge_observations(rows, flagged, F.lit(False), least)
            assert sorted(r.pos for r in out.collect()) == plain(rows, flagged, least)
    assert "FlatMapCoGroupsInPandas" in out._jdf.queryExecution().optimizedPlan().toString()
