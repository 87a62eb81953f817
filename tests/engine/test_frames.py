"""The frame loop as a stream against the same loop in memory, and its memory against plain arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from velograph.operators.tracker import Live
from velograph.streaming.counting import run_in_parts
from velograph.streaming.frames import COLUMNS, COUNTS, Frames, Settings, Track, frame_loop, rows_of, summary
from velograph.streaming.memory import Limits, Memory, velocity

LINE = ((0.0, 200.0), (600.0, 200.0))
KINDS = "run_id string, frame_index long, pos long, t double, x1 double, y1 double, x2 double, y2 double, confidence double, inside_roi boolean, edge boolean, flagged boolean, sharpness double, edge_margin double, crop_area double, vector array<double>, ends boolean"


def recording(run, seed, cars=12, frames=90):
    """Cars that drive down the picture, with gaps in which nothing is detected, noise, and looks of their own."""
    rng = np.random.default_rng(seed)
    start, way = rng.integers(0, 60, cars), rng.uniform(5, 9, cars)
    left, looks = rng.uniform(0, 500, cars), rng.normal(size=(cars, 6))
    out, pos = [], 0
    for f in range(frames):
        for c in range(cars):
            y = float(20 + (f - start[c]) * way[c])
            if not (0 <= f - start[c] < 60) or (f - start[c]) % 17 in (9, 10, 11, 12) and c % 2:
                continue
            x, w = float(left[c] + rng.normal()), float(120 + rng.normal())
            out.append((run, f, pos, f / 10, x, y, x + w, y + 80, float(rng.choice([0.5, 0.9])), bool(y > 60), False, bool(rng.random() < 0.03), float(rng.random()), 0.0, w * 80, (looks[c] + rng.normal(size=6) * 0.1).tolist(), False))
            pos += 1
    return out


def plain(rows, settings):
    """All outputs of the loop over one run's rows, kept in a dictionary."""
    tracks: dict[int, Track] = {}
    live = Live(**settings.tracker) if settings.tracker is not None else None
    memory = Memory(settings.limits, settings.project) if settings.limits else None
    loop = Frames(settings, lambda k: tracks.setdefault(k, Track()), live, memory)
    table = pd.DataFrame(rows, columns=[c.split()[0] for c in KINDS.split(", ")])
    out = [r for _, part in table.groupby("frame_index") for r in loop.frame(part, 0)]
    return out + [summary(k, v) for k, v in tracks.items() if v.frames_seen], loop.counts


def shown(rows, kind):
    names = COLUMNS[kind][1:]
    near = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 9) if isinstance(v, float) else v
    return sorted((tuple(near(r.get(c)) for c in names) for r in rows if r["kind"] == kind), key=str)


@pytest.mark.parametrize("project", [None, lambda x, y: (x / 60, y / 20)])
def test_stream_with_restarts_equals_the_loop_in_memory(spark, project):
    settings = Settings(after=1.0, world_gap=2.0, reach=400, speed=400, line=LINE, project=project, tracker={"start": 0.5, "lost": 3}, limits=Limits(similarity=0.8), embed_every=3)
    runs = {f"cam{i}": recording(f"cam{i}", i) for i in range(3)}
    frame = spark.createDataFrame([r for rows in runs.values() for r in rows], KINDS)
    ends = spark.createDataFrame([(run, 1000, 0, *[None] * 13, True) for run in runs], KINDS)
    parts = [frame.where("frame_index < 31"), frame.where("frame_index between 31 and 55"), frame.where("frame_index > 55").union(ends)]
    out = run_in_parts(parts, lambda rows: frame_loop(rows, settings), "test-frames")
    got = {run: [r.asDict() for r in out.where(F.col("run_id") == run).collect()] for run in runs}
    taken = 0
    for run, rows in runs.items():
        want, counts = plain(rows, settings)
        for kind in ("row", "dropped", "rescue", "track"):
            assert shown(got[run], kind) == shown(want, kind), (run, kind)
        assert {r["name"]: r["n"] for r in got[run] if r["kind"] == "count"} == counts and set(counts) == set(COUNTS)
        taken += counts["rescued"]
        assert counts["accepted"] + counts["edge_skipped"] + counts["suppressed"] == counts["rows"] and counts["counted"] > 3 and counts["crops"] > 5
        events = [r for r in got[run] if r["kind"] == "rescue"]
        assert len(events) == counts["rescued"] + counts["rescues_refused"] and all((r["reason"] is None) == (r["outcome"] == "accepted") for r in events)
    assert taken > 5


def test_takeover_keeps_one_id_where_the_tracker_alone_would_give_two():
    look = [1.0, 2.0, 0.5]
    rows = [("a", f, f, f / 10, 90.0, 20.0 + 8 * f, 210.0, 100.0 + 8 * f, 0.9, True, False, False, 0.0, 0.0, 1.0, look, False) for f in range(50) if not 20 <= f < 30]
    with_ = Settings(after=None, tracker={"start": 0.4, "lost": 3}, limits=Limits())
    assert len({r["track_id"] for r in plain(rows, with_)[0] if r["kind"] == "row"}) == 1
    assert len({r["track_id"] for r in plain(rows, with_._replace(limits=None))[0] if r["kind"] == "row"}) == 2
    # ids that are seen in the frame are no source
    rows += [(*r[:2], r[2] + 1000, r[3], r[4] + 2000, *r[5:6], r[6] + 2000, *r[7:]) for r in rows]
    rows.sort(key=lambda r: (r[1], r[2]))
    assert len({r["track_id"] for r in plain(rows, with_)[0] if r["kind"] == "row"}) == 2


def test_retired_ids_go_back_to_the_tracker():
    """An id that jumps is dropped, its path forgotten, and the vehicle gets a fresh id that stays visible."""
    row = lambda f, pos, x: ("a", f, pos, f / 10, x, 100.0, x + 120, 180.0, 0.9, True, False, False, 0.0, 0.0, 1.0, [1.0, 0.0], False)
    rows = [row(f, f, 10.0 + f) for f in range(5)] + [row(f, f, 10.0 + f) for f in range(12, 20)]
    out, counts = plain(rows, Settings(after=0.35, world_gap=0.0, tracker={"start": 0.4, "lost": 30}, limits=Limits()))
    assert [r["track_id"] for r in out if r["kind"] == "dropped"] == [1] and counts["ids_dropped"] == counts["suppressed"] == 1
    assert {r["track_id"] for r in out if r["kind"] == "row" and r["frame_index"] > 12} == {2}


def brute(memory, box, t, busy, vector):
    """Reasons by track, written out from the rules."""
    lim, out = memory.limits, {}
    x, y = ((box[0] + box[2]) / 2, box[3])
    if memory.project:
        x, y = memory.project(x, y)
    for k, points in memory.points.items():
        if k in busy:
            continue
        (lt, lx, ly), gap = points[-1], t - points[-1][0]
        sims = [np.dot(vector, w) / np.linalg.norm(vector) / np.linalg.norm(w) for w in memory.looks.get(k, [])] if vector is not None else []
        moved, high = math.dist((x, y), (lx, ly)), box[3] - box[1]
        v = velocity(points[-lim.fit :])
        checks = [("not_after_last_observation", gap <= 0), ("gap_exceeded", gap > lim.gap), ("insufficient_history", v is None if memory.project else len(points) < 2)]
        failed = next((name for name, bad in checks if bad), None)
        if failed is None and memory.project:
            ex, ey = x - lx - v[0] * gap, y - ly - v[1] * gap
            pace = math.hypot(*v)
            checks = [("speed_exceeded", moved / gap > lim.speed), ("distance_exceeded", math.hypot(ex, ey) > lim.distance)]
            if pace >= lim.moving:
                checks += [("lateral_exceeded", abs(ex * v[1] - ey * v[0]) / pace > lim.lateral), ("behind_prediction", (ex * v[0] + ey * v[1]) / pace < -lim.behind)]
            checks.append(("appearance_mismatch", bool(sims) and max(sims) < lim.similarity))
            failed = next((name for name, bad in checks if bad), None)
        elif failed is None:
            checks = [("degenerate_scale", high <= 0), ("speed_exceeded", moved / gap > lim.pixel_speed * high), ("distance_exceeded", moved > high * min(lim.pixel_distance, lim.pixel_speed * gap)), ("appearance_required", not sims), ("appearance_mismatch", not sims or max(sims) < lim.pixel_similarity)]
            failed = next((name for name, bad in checks if bad), None)
        out[k] = failed
    return out


@pytest.mark.parametrize("project", [None, lambda x, y: (x / 40, y / 15)])
def test_every_refusal_has_its_reason(project):
    rng, reasons = np.random.default_rng(8), set()
    for _ in range(150):
        memory = Memory(Limits(), project)
        for k in range(8):
            t, (x, y), (vx, vy) = rng.uniform(0, 2), rng.uniform(0, 300, 2), rng.uniform(-90, 90, 2)
            for i in range(rng.integers(1, 5)):
                memory.points.setdefault(k, []).append((t + i / 10, *(project or (lambda *a: a))(x + vx * i / 10, y + vy * i / 10)))
            for _ in range(rng.integers(0, 3)):
                memory.looked(k, rng.normal(size=3))
        x, y, high = *rng.uniform(0, 300, 2), rng.choice([0.0, 30.0, 90.0])
        vector = rng.normal(size=3) if rng.random() < 0.8 else None
        best, refused = memory.match((x, y, x + 50, y + high), 2.4, {1}, vector)
        want = brute(memory, (x, y, x + 50, y + high), 2.4, {1}, vector)
        assert {j.track_id: j.reason for j in refused} == {k: r for k, r in want.items() if r}
        good = {k for k, r in want.items() if r is None}
        assert (best is None) == (not good) and (best is None or best.track_id in good)
        reasons |= {r or "good" for r in want.values()}
    assert len(reasons) >= 8, reasons


def test_memory_forgets_and_is_bounded():
    memory = Memory(Limits(gap=2.0, fit=3, looks=2))
    for i in range(10):
        memory.seen(1, i / 10, (i, 0.0))
        memory.looked(1, [1.0, i])
    memory.seen(2, 1.0, (float("nan"), 0.0))
    memory.looked(2, [0.0, 0.0])
    memory.looked(2, None)
    assert len(memory.points[1]) == 3 and len(memory.looks[1]) == 2 and not memory.looks.get(2) and memory.similarity(1, [0.0, 0.0]) is None
    memory.seen(3, 2.95, (0.0, 0.0))
    assert list(memory.points) == [3] and not memory.looks
    assert memory.match((0, 0, float("inf"), 1), 3.0, set()) == (None, [])


def test_tracks_are_closed_by_event_time(spark, tmp_path):
    rows = [("a", f, f, f / 10, float(k * 300), 100.0, k * 300 + 120.0, 180.0, k + 1) for k in range(2) for f in (range(5) if k else range(80))]
    given = spark.createDataFrame(rows, "run_id string, frame_index long, pos long, t double, x1 double, y1 double, x2 double, y2 double, track_id long")
    given = given.withColumn("ts", F.timestamp_millis((F.col("t") * 1000).cast("long") + 10_000))
    run = lambda rows: frame_loop(rows.withWatermark("ts", "1 second"), Settings(after=None), ttl_ms=2000)
    out = run_in_parts([given.where("frame_index < 10"), given.where("frame_index between 10 and 30"), given.where("frame_index between 31 and 59"), given.where("frame_index > 59")], run, "test-ttl")
    assert [(r.track_id, r.frames_seen, r.last_frame) for r in rows_of(out, "track").collect()] == [(2, 5, 4)]
    assert rows_of(out, "row").count() == 85
