"""What a drawing of frames needs to know: the order of labels, texts that fit, and figures that move smoothly."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velograph.functions import boxes

#: How much of the way to its target a row or a bar goes in a frame, and how many frames a new count stands out.
ROW_EASE, BAR_EASE, PULSE = 0.35, 0.30, 8


def draw_order(rows: DataFrame) -> DataFrame:
    """``place`` of each label in its frame: smaller boxes first, so that larger ones are drawn over them; equal ones keep
    the order of the frame."""
    w = Window.partitionBy("run_id", "frame_index").orderBy(boxes.area(F.col("bbox")), "pos")
    return rows.withColumn("place", F.row_number().over(w))


def truncated(text: Column, limit: float, width: Callable[[str], float], dots: str = "...") -> Column:
    """The text if it is at most ``limit`` wide, else the longest beginning of it that is so with dots, without a space
    before them; the dots alone if no beginning fits, and nothing if they do not.  ``width`` measures a text; null stays."""

    def fitted(whole: str) -> str:
        if limit <= 0:
            return ""
        if width(whole) <= limit:
            return whole
        if width(dots) > limit:
            return ""
        short = (whole[:n].rstrip() + dots for n in range(len(whole.rstrip()), 0, -1))
        return next((s for s in short if width(s) <= limit), dots)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(fitted, na_action="ignore")

    return run(text)


def eased(rows: DataFrame, stride: float) -> DataFrame:
    """(run_id, frame_index, make, y, progress, pulse) of the rows of a list as they are drawn, frame by frame.

    ``rows``: run_id, frame_index, make, place (from 0), n, progress of the makes that a frame shows.  A row starts one
    ``stride`` below its place and goes a part of the way to it in each frame, a bar from 0 likewise, and the pulse is the
    number of frames for which a new or larger count still stands out.  A make that a frame does not show starts anew.
    """
    drawn = Window.partitionBy("run_id").orderBy("frame_index")
    frames = rows.select("run_id", "frame_index").distinct().withColumn("_o", F.row_number().over(drawn))
    dealt = rows.join(frames, ["run_id", "frame_index"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_o")
        order, place, n = (group[c].to_numpy() for c in ("_o", "place", "n"))
        goal = np.clip(group["progress"].to_numpy(float), 0.0, 1.0)
        y, bar, pulse = np.zeros(len(group)), np.zeros(len(group)), np.zeros(len(group), np.int32)
        for i in range(len(group)):
            target = float(place[i]) * stride
            held = i > 0 and order[i] == order[i - 1] + 1
            before, was = (y[i - 1], bar[i - 1]) if held else (target + stride, 0.0)
            y[i], bar[i] = before + (target - before) * ROW_EASE, was + (goal[i] - was) * BAR_EASE
            pulse[i] = PULSE if not held or n[i] > n[i - 1] else max(0, pulse[i - 1] - 1)
        return group[["run_id", "frame_index", "make"]].assign(y=y, progress=bar, pulse=pulse)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"run_id {kinds['run_id']}, frame_index {kinds['frame_index']}, make {kinds['make']}, y double, progress double, pulse int"
    return dealt.select("run_id", "frame_index", "make", "place", "n", "progress", "_o").groupBy("run_id", "make").applyInPandas(run, schema)
