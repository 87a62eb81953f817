"""A fresh detection meets all lost tracks of its run at once, and boxes meet tracks in blocks."""

from __future__ import annotations

import numpy as np
import pytest

from velograph.operators import tracker
from velograph.operators.tracker import Live
from velograph.streaming.counting import run_in_parts
from velograph.streaming.frames import INPUT, Frames, Settings, Track, frame_loop, rows_of
from velograph.streaming.memory import Limits, Memory
from tests.engine.test_frames_in_pieces import given


def crowd(n, project=None):
    rng, memory = np.random.default_rng(5), Memory(Limits(gap=60.0, pixel_speed=1.0, speed=900.0, distance=500.0, lateral=200.0), project)
    for k in range(n):
        x, y = rng.uniform(0, 900), rng.uniform(0, 600)
        for i in range(1 + k % 4):
            memory.points.setdefault(k, []).append((i / 2, float(x + rng.normal()), float(y + rng.normal())))
        for _ in range(k % 3):
            memory.looked(k, rng.normal(size=4))
    return memory


@pytest.mark.parametrize("project", [None, lambda x, y: (x, y)])
def test_lost_tracks_are_not_compared_one_by_one(monkeypatch, project):
    memory, calls = crowd(3000, project), []
    for name in ("similarity", "forget"):
        monkeypatch.setattr(memory, name, lambda *a, own=getattr(memory, name): calls.append(1) or own(*a))
    vector = np.random.default_rng(6).normal(size=4)
    best, refused = memory.match((400, 300, 460, 400), 30.0, {7}, vector)
    assert not calls
    # a track judged by itself gives the same
    alone = {}
    for k in set(memory.points) - {7}:
        own = Memory(memory.limits, project)
        own.points, own.looks = {k: memory.points[k]}, {k: memory.looks[k]} if k in memory.looks else {}
        good, bad = own.match((400, 300, 460, 400), 30.0, set(), vector)
        alone[k] = good or bad[0]
    good = [j for j in alone.values() if j.reason is None]
    assert refused == [alone[k] for k in sorted(alone) if alone[k].reason] and len({j.reason for j in refused}) > 2
    assert good and best == min(good, key=lambda j: (j.distance, -(j.similarity or 0.0), j.track_id))


def test_pairs_in_blocks_are_taken_in_the_order_of_their_worth(monkeypatch):
    rng = np.random.default_rng(7)
    corner = rng.integers(0, 12, (60, 2)) * 20.0
    boxes = np.concatenate([corner, corner + 50], axis=1)
    tracks = [{"id": i, "frame": 0, "box": b, "v": np.zeros(4)} for i, b in enumerate(boxes[:35])]
    weight = rng.choice([0.5, 1.0], 25)
    worth = tracker.iou_matrix(boxes[:35], boxes[35:])
    worth, wanted = np.where(worth >= 0.2, worth * weight, -1.0), []
    while worth.max() > 0:
        i, j = np.argwhere(worth == worth.max())[0]
        wanted.append((int(i), int(j)))
        worth[i, :] = worth[:, j] = -1.0
    monkeypatch.setattr(tracker, "PAIRS_AT_ONCE", 60)
    assert Live()._greedy(tracks, boxes[35:], weight, 1) == wanted and len(wanted) > 10


def test_few_runs_have_few_stores(spark, monkeypatch):
    rows = given(40).drop(columns="vector").astype({"track_id": "int64"})
    table = spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in INPUT.items() if c != "vector"))
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        out = run_in_parts([table], lambda t: seen.append(spark.conf.get("spark.sql.shuffle.partitions")) or frame_loop(t, Settings(after=1e9)), "few")
        assert seen == ["4"] and spark.conf.get("spark.sql.shuffle.partitions") == "40" and rows_of(out, "track").count() == 7
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_frame_gives_comparisons_as_columns():
    own = Settings(after=None, tracker={"start": 0.5}, limits=Limits())
    loop = Frames(own, {k: Track() for k in range(99)}.__getitem__, Live(**own.tracker), crowd(50))
    loop.live.fresh = 60
    rows = given(2)[:1].assign(frame_index=9, t=5.0, vector=[np.ones(4)])
    events = [m for m in loop.pieces(rows, 0) if not isinstance(m, dict)]
    assert len(events) == 1 and len(events[0]) == 50 == loop.counts["rescues_refused"] + loop.counts["rescued"]
