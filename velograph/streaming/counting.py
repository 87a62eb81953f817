"""Counting and retiring tracks as observations arrive: the batch windows of ``operators.tracks`` as state a track.

State a track is a few numbers and flags, dropped after ``ttl_ms`` of event time without an observation.  Rows of a
track must arrive in order across micro-batches; within one they are sorted.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from velograph.plans.materialize import materialize, shared_dir

#: Stores of state for each run, so that few runs share one, and at most as many as a shuffle has partitions.
STORES = 4
OUTPUT = "run_id string, track_id long, frame_index long, pos long, t double, inside_roi boolean, retired boolean, counted boolean, crossing string"
STATE = "t double, x double, y double, retired boolean, counted boolean, side int"


def _side(x: np.ndarray, y: np.ndarray, line: tuple[tuple[float, float], tuple[float, float]] | None) -> np.ndarray:
    """1 and -1 on either side of the line, 0 on it and beyond its ends."""
    if line is None:
        return np.zeros(len(x), np.int64)
    (ax, ay), (bx, by) = line
    dx, dy = bx - ax, by - ay
    along = (x - ax) * dx + (y - ay) * dy
    return np.where((along >= 0) & (along <= dx * dx + dy * dy), np.sign((y - ay) * dx - (x - ax) * dy), 0).astype(np.int64)


def track_states(
    rows: DataFrame, *, after: float = 0.35, world_gap: float = 2.0, reach: float = 150.0, speed: float = 40.0, ttl_ms: int | None = None,
    line: tuple[tuple[float, float], tuple[float, float]] | None = None, direction: str = "BOTH", time: str = "ts",
) -> DataFrame:
    """``rows`` (run_id, track_id, frame_index, pos, t, x, y, inside_roi) with retired, counted and crossing; for
    streams (``run_once`` takes a table through one).  Retired rows stay in the output, marked, and count no more.

    Without a ``line`` a track counts from its first row inside the region.  With one it counts from the first row inside
    on which it has crossed the line in the wanted ``direction`` (A_TO_B, B_TO_A or BOTH); the side it was last seen on
    is state.  With ``ttl_ms`` the column ``time`` must have a watermark, and a track whose last row is so far behind it
    is forgotten.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        t, x, y, retired, counted, side = state.getOption or (None, 0.0, 0.0, False, False, 0)
        own = pd.concat(list(batches)).sort_values(["frame_index", "pos"])
        sides = _side(own["x"].to_numpy(float), own["y"].to_numpy(float), line).tolist()
        gone, count, crossed = [], [], []
        for at, px, py, inside, now in zip(own["t"].tolist(), own["x"].tolist(), own["y"].tolist(), own["inside_roi"].fillna(False).tolist(), sides, strict=True):
            if t is not None and key[1] >= 0 and not retired:
                gap, dist = at - t, ((px - x) ** 2 + (py - y) ** 2) ** 0.5
                retired = gap > after and not (gap <= world_gap and dist <= min(reach, speed * gap))
            way = None
            if not retired:
                t, x, y = at, px, py
                way = None if not now or not side or now == side else "A_TO_B" if now > 0 else "B_TO_A"
                side = now or side
                counted = counted or (bool(inside) if line is None else bool(inside) and way is not None and direction in ("BOTH", way))
            gone.append(retired)
            count.append(counted)
            crossed.append(way)
        state.update((t, x, y, retired, counted, side))
        if ttl_ms:
            state.setTimeoutTimestamp(max(int(own["_at"].max()), state.getCurrentWatermarkMs()) + ttl_ms)
        yield pd.DataFrame({"run_id": key[0], "track_id": key[1], **{c: own[c].to_numpy() for c in ("frame_index", "pos", "t", "inside_roi")}, "retired": gone, "counted": count, "crossing": crossed})

    # the column with the watermark has to reach the operator as it is
    at = [F.col(time), F.unix_millis(time).alias("_at")] if ttl_ms else []
    own = rows.select("run_id", "track_id", "frame_index", "pos", "t", "x", "y", "inside_roi", *at)
    timeout = GroupStateTimeout.EventTimeTimeout if ttl_ms else GroupStateTimeout.NoTimeout
    return own.groupBy("run_id", "track_id").applyInPandasWithState(run, OUTPUT, STATE, "append", timeout)


def run_once(table: DataFrame, operator: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """A table taken through an operator on streams as all that there is, in the shared folder."""
    spark = table.sparkSession
    given = materialize(table, f"{name}-in")
    out = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    made = operator(spark.readStream.schema(given.schema).parquet(given._velograph_path))
    made.writeStream.format("parquet").option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(made.schema).parquet(out)


def run_in_parts(parts: list[DataFrame], operator: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Tables taken through an operator on streams one after the other, each by a query of its own that starts from the
    state the last one left.  State is kept in RocksDB, with its checkpoints in the shared folder, and by run: where runs
    are few, so are the stores, as each one is opened and written for every part."""
    spark = parts[0].sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    stores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    runs = reduce(DataFrame.unionAll, [p.select("run_id") for p in parts]).distinct().limit(stores).count()
    own = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(max(1, min(stores, STORES * runs)))}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        for part in parts:
            part.select(parts[0].columns).write.mode("append").parquet(f"{at}-in")
            made = operator(spark.readStream.schema(parts[0].schema).parquet(f"{at}-in"))
            made.writeStream.format("parquet").option("checkpointLocation", f"{at}-state").trigger(availableNow=True).start(at).awaitTermination()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(made.schema).parquet(at)


def windowed_counts(rows: DataFrame, time: str = "ts", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(window_start, class_name, n) of tumbling or sliding windows over a stream, late rows up to ``late`` included."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return rows.withWatermark(time, late).groupBy(w.alias("w"), "class_name").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "class_name", "n")


def sessions(rows: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", key: str = "track_id", time: str = "ts") -> DataFrame:
    """(key, session_start, session_end, n) of runs of events with no longer pause than ``gap``."""
    w = F.session_window(time, gap)
    return rows.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
