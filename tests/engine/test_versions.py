"""Versions that are published without renames, nested records, and labels of tracks."""

from __future__ import annotations

import threading

import pytest
from pyspark.sql import functions as F

from velograph.operators import dedup, report, tracker
from velograph.plans import config
from velograph.sources import sinks
from velograph.sources.readers import sampled_frames, sampled_frames_of


def one(spark, n):
    return spark.createDataFrame([(n,)], "n long")


def shown(spark, root, name="t"):
    return spark.read.parquet(sinks.current(spark, root, name)).first()[0]


def test_a_reader_always_finds_a_version(spark, tmp_path):
    root, seen, stop = f"{tmp_path}/table", [], threading.Event()
    assert sinks.current(spark, root, "t") is None and sinks.publish({"t": one(spark, 0), "u": one(spark, 100)}, root, keep=9) == 1

    def read():
        while not stop.is_set():
            seen.append((shown(spark, root), shown(spark, root, "u")))

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 5):
        assert sinks.publish({"t": one(spark, i), "u": one(spark, 100 + i)}, root, keep=9) == i + 1
    stop.set()
    reader.join()
    assert seen and [t for t, _ in seen] == sorted(t for t, _ in seen) and all(u in (100 + t, 101 + t) for t, u in seen) and shown(spark, root) == 4


def test_what_fails_leaves_the_version_before(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/table"
    sinks.publish({"t": one(spark, 1)}, root)
    bad = one(spark, 2).select(F.raise_error(F.lit("no")).cast("long").alias("n"))
    with pytest.raises(Exception, match="no"):
        sinks.publish({"t": one(spark, 2), "u": bad}, root)
    monkeypatch.setattr(sinks, "_switch", lambda *a: (_ for _ in ()).throw(OSError("full")))
    with pytest.raises(OSError, match="full"):
        sinks.publish({"t": one(spark, 2)}, root)
    monkeypatch.undo()
    assert shown(spark, root) == 1 and len([p for p in tmp_path.joinpath("table").iterdir() if p.name.startswith("data-")]) == 1
    tmp_path.joinpath("table/_versions/000000000002").write_text("data-half")  # a writer that died while it switched
    assert shown(spark, root) == 1 and sinks.publish({"t": one(spark, 3)}, root) == 3 and shown(spark, root) == 3
    assert sinks.publish({"t": one(spark, 4)}, root) == 4 and len([p for p in tmp_path.joinpath("table").iterdir() if p.name.startswith("data-")]) == 2


def test_writers_at_one_time_all_get_a_version(spark, tmp_path):
    root, got = f"{tmp_path}/table", []
    threads = [threading.Thread(target=lambda i=i: got.append(sinks.publish({"t": one(spark, i)}, root, keep=9))) for i in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got) == [1, 2, 3, 4] and shown(spark, root) in range(4)


def test_nested_records_are_rewritten_in_place(spark):
    kind = "run_id string, frame_index int, other string, tracks array<struct<track_id:long,vehicle_index:long,x:double>>"
    frames = spark.createDataFrame([("a", 1, "o", [(1, None, 0.5), (2, 7, 1.5), (None, 3, 2.5)]), ("a", 2, None, []), ("a", 3, "n", None), ("b", 1, "p", [(1, 4, 0.0)])], kind)
    vehicles = spark.createDataFrame([("a", 1, 9), ("a", 1, 8), ("a", 5, 1), ("a", None, 6), ("a", 2, None)], "run_id string, track_id long, vehicle_index long")
    got = {(r.run_id, r.frame_index): r.tracks and [tuple(t) for t in r.tracks] for r in dedup.renumber_nested(frames, vehicles).collect()}
    assert got == {("a", 1): [(1, 8, 0.5), (2, 7, 1.5), (None, 3, 2.5)], ("a", 2): [], ("a", 3): None, ("b", 1): [(1, 4, 0.0)]}
    assert dedup.renumber_nested(frames, vehicles.limit(0)).columns == frames.columns


def test_labels_of_tracks(spark):
    tracks = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, None), ("a", 4, 6), ("b", 1, 5)], "run_id string, track_id long, vehicle_index long")
    labels = spark.createDataFrame([("a", 2, 5, "two"), ("a", 9, 5, "nine"), ("a", 4, 6, None)], "run_id string, track_id long, vehicle_index long, label string")
    want = {("a", 1): ("two", "vehicle"), ("a", 2): ("two", "track"), ("a", 3): (None, None), ("a", 4): (None, "track"), ("b", 1): (None, None)}
    assert {(r.run_id, r.track_id): (r.label, r.labelled) for r in report.labelled(tracks, labels).collect()} == want
    assert {(r.run_id, r.track_id) for r in report.labelled(tracks, labels, inner=True).collect()} == {k for k, v in want.items() if v[1]}


def test_suppression_is_by_frame(spark):
    rows = [("a", f, i, (x, 0.0, x + 10, 10.0), c, "k") for f in (0, 1, 255, 256, 600) for i, (x, c) in enumerate([(0.0, 0.5), (1.0, 0.9), (30.0, 0.4), (1.0, 0.9)])]
    frame = spark.createDataFrame(rows, "run_id string, frame_index long, pos long, bbox struct<x1:double,y1:double,x2:double,y2:double>, confidence double, class_name string")
    assert sorted((r.frame_index, r.pos) for r in tracker.suppress(frame, 0.5).collect()) == [(f, i) for f in (0, 1, 255, 256, 600) for i in (1, 2)]


def test_frames_of_videos_in_a_table(spark):
    videos = [(1, 200, 29.97, 10.0), (2, 0, 25.0, 10.0), (3, 50, 10.0, 25.0), (4, 77, 30.0, 7.5)]
    table = spark.createDataFrame(videos, "run_id long, frames long, source_fps double, target_fps double")
    got = [tuple(r) for r in sampled_frames_of(table, terminal=True).collect()]
    want = [(k, r.frame_index, r.t) for k, n, f, g in videos if n for r in sampled_frames(spark, n, f, g, terminal=True).collect()]
    assert sorted(got) == sorted(want)
    with pytest.raises(Exception, match="frame rates are positive"):
        sampled_frames_of(spark.createDataFrame([(1, 5, 0.0, 1.0)], table.schema)).collect()


def test_the_plane_can_be_turned_off():
    square = [[0, 0], [1, 0], [1, 1], [0, 1]]
    camera = config.Camera.of({"camera_id": "c", "polygon": square, "homography": {"source_points": square, "target_points": square}})
    assert config.plane_of(camera) is camera.homography and config.plane_of(camera, enabled=False) is None


def test_a_calibration_is_kept_only_if_it_found_a_threshold(spark, tmp_path):
    kind, root = "same_pairs long, conflict_pairs long, max_same double, min_conflict double, threshold double, compared long", f"{tmp_path}/calibration"
    good, bad = (spark.createDataFrame([row], kind) for row in ((3, 4, 0.1, 0.2, 0.1, 5), (3, 4, 0.3, 0.2, None, 5)))
    assert sinks.load_calibration(spark, root, "m", 8, 4) is None
    assert not sinks.save_calibration(bad, root, "m", 8, 4) and sinks.load_calibration(spark, root, "m", 8, 4) is None
    assert sinks.save_calibration(good, root, "m", 8, 4) and not sinks.save_calibration(bad, root, "m", 8, 4)
    assert sinks.load_calibration(spark, root, "m", 8, 4) == 0.1
    assert [sinks.load_calibration(spark, root, *other) for other in (("n", 8, 4), ("m", 9, 4), ("m", 8, None))] == [None] * 3
