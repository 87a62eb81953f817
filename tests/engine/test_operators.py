from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from velograph.functions import boxes
from velograph.operators import aggregates, components, dedup, filters, joins, link, report, retrieval, smooth, tracker, tracks

OBS = "run_id string, track_id long, frame_index long, pos long, t double, x1 double, y1 double, x2 double, y2 double, vehicle_index long, inside_roi boolean, confidence double, class_name string, counted boolean, crossed_line boolean"


def obs(spark, rows):
    """(track, frame, t, x, y[, vehicle, inside]) with boxes of 40 x 30 whose bottom center is (x, y)."""
    full = []
    for n, (track, frame, t, x, y, *rest) in enumerate(rows):
        vehicle, inside = (*rest, None, True)[:2] if len(rest) < 2 else rest
        full.append(("r", track, frame, n, float(t), x - 20.0, y - 30.0, x + 20.0, float(y), vehicle, inside, 0.5, "car", False, False))
    frame = spark.createDataFrame(full, OBS)
    return frame.withColumn("bbox", boxes.box("x1", "y1", "x2", "y2")).drop("x1", "y1", "x2", "y2")


def foot():
    b = boxes.bottom_center(F.col("bbox"))
    return b["x"], b["y"]


def world():
    b = boxes.bottom_center(F.col("bbox"))
    return b["x"] / 10, b["y"] / 10


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == {x: c for x, c in want.items() if True} and len(got) == len(want)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_speeds(spark):
    rows = obs(spark, [(1, 0, 0.0, 100, 0), (1, 1, 0.5, 160, 0), (1, 2, 1.0, 300, 0), (2, 0, 0.0, 5, 0), (3, 0, 1.0, 5, 0), (3, 1, 1.0, 9, 0)])
    assert [tuple(r) for r in tracks.speeds(rows, *world()).collect()] == [("r", 1, 20.0, 28.0)]


def test_line_crossings_and_counting(spark):
    down = [(1, i, i, 50, y) for i, y in enumerate([30, 45, 55, 70, 40])]
    beside = [(2, i, i, 150, y) for i, y in enumerate([30, 70])]
    late = [(3, 0, 0, 20, 70, None, True), (3, 1, 1, 20, 40, None, False), (3, 2, 2, 20, 60, None, True), (3, 3, 3, 20, 50, None, True), (3, 4, 4, 20, 40, None, True)]
    rows = tracks.line_crossings(obs(spark, down + beside + late), (0, 50), (100, 50), *foot())
    got = {(r.track_id, r.frame_index): r.crossing for r in rows.collect() if r.crossing}
    assert got == {(1, 2): "A_TO_B", (1, 4): "B_TO_A", (3, 1): "B_TO_A", (3, 2): "A_TO_B", (3, 4): "B_TO_A"}
    counted = tracks.first_crossing(rows, "B_TO_A").where("crossed_line").collect()
    assert {(r.track_id, r.frame_index) for r in counted} == {(1, 4), (3, 4)}


def test_retirement(spark):
    rows = obs(spark, [(1, 0, 0.0, 0, 0), (1, 1, 0.2, 10, 0), (1, 2, 1.0, 20, 0), (1, 3, 1.1, 21, 0), (2, 0, 0.0, 0, 0), (2, 1, 1.0, 100, 0), (2, 2, 1.1, 101, 0), (-1, 0, 0.0, 0, 0), (-1, 1, 9.0, 900, 0)])
    kept = tracks.retire_stale(rows, *foot())
    assert sorted((r.track_id, r.frame_index) for r in kept.collect()) == [(-1, 0), (-1, 1), (1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
    assert tracks.retire_stale(rows, *foot(), after=None).count() == 9


def chain(spark):
    rows = [(61, 10, 1.0, 520, 0), (62, 11, 1.1, 520, 25), (63, 12, 1.2, 520, 50)] + [(64, 13 + i, 1.3 + i / 10, 520, 75 + 25 * i, 5) for i in range(30)]
    return tracks.endpoints(obs(spark, rows), *world())


def test_linking_a_chain_of_fragments(spark):
    ends = chain(spark)
    links = link.accepted_links(link.link_pairs(ends, max_speed=45.0))
    assert sorted((r.a_track_id, r.b_track_id, round(r.gap, 3)) for r in links.where("accepted").collect()) == [(61, 62, 0.1), (62, 63, 0.1), (63, 64, 0.1)]
    merged = link.merged_vehicles(ends, links)
    assert sorted(tuple(r)[1:] for r in merged.collect()) == [(61, 61, 5), (62, 61, 5), (63, 61, 5), (64, 61, 5)]
    audit = link.link_audit(ends, links, merged).first()
    assert (audit.input_track_count, audit.input_vehicle_count, audit.output_vehicle_count) == (4, 1, 1) and (audit.merge_group_count, audit.merged_track_count, audit.ambiguous_pair_count) == (1, 4, 3)
    rows = [r.asDict() for r in link.link_evidence(links, merged).orderBy("from_track_id", "to_track_id").collect()]
    shown = [(r["kind"], r["group"], r["canonical_vehicle_index"], r["from_track_id"], r["to_track_id"]) for r in rows]
    assert shown == [("merged" if b == a + 1 else "ambiguous", 61 if b == a + 1 else None, 5 if b == a + 1 else None, a, b) for a in (61, 62, 63) for b in range(a + 1, 65)]
    assert all(abs(r["implied_speed"] - r["distance"] / r["gap_seconds"]) < 1e-9 for r in rows)


def test_ambiguous_links_are_mutually_best_only(spark):
    rows = [(1, 0, 1.0, 500, 100, 1), (2, 0, 1.0, 501, 100, 2), (3, 2, 1.2, 501, 130, 3)]
    ends = tracks.endpoints(obs(spark, rows), *world())
    links = link.accepted_links(link.link_pairs(ends))
    assert {(r.a_track_id, r.b_track_id): r.accepted for r in links.collect()} == {(1, 3): False, (2, 3): True}


def test_gap_gate(spark):
    rows = [(1, 0, 1.0, 500, 100), (2, 5, 1.5, 500, 130)]
    assert link.link_pairs(tracks.endpoints(obs(spark, rows), *world())).count() == 0


def test_sequential_duplicates_and_bridges(spark):
    rows = obs(spark, [(1, 0, 0.0, 120, 60, 1), (1, 1, 0.1, 130, 60, 1), (2, 3, 0.3, 150, 60, 2), (2, 4, 0.4, 160, 60, 2)])
    labels = spark.createDataFrame([("r", 1, 1, True, "car", " Audi", "A4"), ("r", 2, 2, True, "car", "audi", "a4 ")], "run_id string, track_id long, vehicle_index long, accepted boolean, category string, make string, model string")
    h = np.diag([0.1, 0.1, 1.0])
    pairs = dedup.duplicate_pairs(dedup.track_ends(rows), labels, homography=h, max_speed=15.0)
    p = pairs.first()
    assert p.identity_match and p.passes and p.speed == pytest.approx(10) and p.error == pytest.approx(0)
    assert not dedup.duplicate_pairs(dedup.track_ends(rows), labels, homography=h, max_speed=5.0).first().passes
    canonical = dedup.canonical_vehicles(pairs)
    assert {r.vehicle_index: r.canonical for r in canonical.collect()} == {1: 1, 2: 1}
    assert {r.vehicle_index for r in dedup.renumber(rows, canonical).collect()} == {1}
    frames = spark.createDataFrame([("r", i, i / 10) for i in range(6)], "run_id string, frame_index long, t double")
    made = sorted((r.track_id, r.frame_index, r.bbox.x1) for r in dedup.bridges(rows, pairs, frames).collect())
    assert made == [(1, 2, pytest.approx(120)), (1, 3, pytest.approx(130))]


def test_gaps_and_frames_between(spark):
    rows = obs(spark, [(1, 0, 0.0, 100, 50), (1, 3, 0.3, 130, 50), (2, 0, 0.0, 100, 50), (2, 1, 0.1, 100, 50)])
    frames = smooth.record_positions(spark.createDataFrame([("r", i, i / 10) for i in range(4)], "run_id string, frame_index long, t double"))
    placed = rows.join(frames.select("run_id", "frame_index", "position"), ["run_id", "frame_index"])
    made = smooth.bridge_gaps(placed, frames)
    assert sorted((r.track_id, r.frame_index, round(r.bbox.x1, 6)) for r in made.collect()) == [(1, 1, 90.0), (1, 2, 100.0)]
    assert smooth.bridge_gaps(placed, frames, most=1).count() == 0
    wide = obs(spark, [(1, 0, 0.0, 100, 50), (1, 3, 0.1, 130, 50), (2, 3, 0.1, 5, 5), (2, 9, 0.9, 5, 5)])
    seen = spark.createDataFrame([("r", 0, 0.0), ("r", 3, 0.1), ("r", 9, 0.9)], "run_id string, frame_index long, t double")
    made, clears = smooth.interpolate_frames(wide, seen, 30.0)
    assert sorted((r.track_id, r.frame_index) for r in made.collect()) == [(1, 1), (1, 2)] and [tuple(r) for r in clears.collect()] == [("r", 4)]


def test_fitted_boxes_at_the_ends(spark):
    xs = [100, 110, 150, 130, 140, 150, 160]
    rows = obs(spark, [(1, i, i / 10, x, 50) for i, x in enumerate(xs)]).withColumn("position", F.col("frame_index"))
    got = [r.c for r in smooth.fitted_boxes(rows).orderBy("frame_index").select(boxes.center(F.col("smooth"))["x"].alias("c")).collect()]
    for i, x in enumerate(xs):
        first = min(max(i - 2, 0), 2)
        line = np.polyval(np.polyfit(range(first, first + 5), xs[first : first + 5], 1), i)
        assert got[i] == pytest.approx(min(max(line, x - 4), x + 4))


def test_asof_and_range_pairs(spark):
    left = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.5), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 2.0, 20), ("a", 3.0, 30)], "k string, t double, v int")
    assert sorted((r.k, r.t, r.v) for r in joins.asof(left, right, "t", ["k"], ["v"]).collect()) == [("a", 1.0, None), ("a", 2.0, 20), ("a", 3.5, 30), ("b", 1.0, None)]
    rng = random.Random(5)
    a = [("a", i, rng.uniform(0, 30)) for i in range(80)]
    l, r = spark.createDataFrame(a, "k string, i int, s double"), spark.createDataFrame(a, "k string, j int, u double")
    got = {(x.i, x.j) for x in joins.range_pairs(l, r, F.col("s"), F.col("s") + 2, F.col("u"), 1.3, ["k"]).collect()}
    assert got == {(i, j) for _, i, s in a for _, j, u in a if s < u <= s + 2}


def test_overlap_and_best_crop(spark):
    rows = obs(spark, [(1, 0, 0.0, 100, 50, 1), (2, 0, 0.0, 120, 50, 2), (3, 0, 0.0, 500, 50, 3)])
    over = {r.track_id: r.overlap for r in aggregates.sibling_overlap(rows).collect()}
    assert over == {1: 0.5, 2: 0.5, 3: 0.0}
    c = spark.createDataFrame([("r", 1, 10, 0.2, 75.0, 0.0, 100.0, 1.0, 1.0, 1.0, 0), ("r", 1, 11, 0.1, 10.0, 0.0, 100.0, 1.0, 1.0, 1.0, 1), ("r", 1, 12, 0.0, 70.0, 0.0, 100.0, 1.0, 1.0, 1.0, 2), ("r", 1, 12, 0.0, 80.0, 0.0, 100.0, 1.0, 1.0, 1.0, 3)], "run_id string, vehicle_index int, frame_index int, overlap double, width double, min_width double, max_width double, sharpness double, edge_margin double, area double, ord int")
    assert aggregates.best_crop(c, "run_id", "vehicle_index").first().ord == 2


def test_make_counts(spark):
    rows = spark.createDataFrame([("r", i, 0, i, "A" if i < 2 else f"M{i}") for i in range(11)], "run_id string, vehicle_index int, frame_index int, pos int, make string")
    got = [(r.make, r.n, r.progress) for r in aggregates.make_counts(rows).collect()]
    assert got[0] == ("A", 2, 1.0) and got[1] == ("M10", 1, 0.5) and len(got) == 10


def test_calibration(spark):
    rows = [("c", i, [1.0, 0.01 * i, 0.0], "a") for i in range(3)] + [("c", 3 + i, [0.0, 0.0, 1.0], "b") for i in range(3)]
    frame = spark.createDataFrame(rows, "contract string, ord int, embedding array<double>, name string")
    r = retrieval.calibration(frame, F.col("name"), keys=["contract"]).first()
    assert (r.same_pairs, r.conflict_pairs) == (6, 9) and r.threshold == r.max_same < r.min_conflict


def test_records_are_superseded_not_changed(spark):
    records = spark.createDataFrame([("x", "old", None, False), ("y", "fine", None, False)], "record_id string, result string, supersedes_record_id string, by_human boolean")
    fix = spark.createDataFrame([("x", "new")], "record_id string, result string")
    records = records.withColumn("result", F.struct(F.col("result").alias("make")))
    new = retrieval.superseding(records, fix.withColumn("result", F.struct(F.col("result").alias("make"))))
    active = joins.active_records(records.unionByName(new)).collect()
    assert sorted(r.result.make for r in active) == ["fine", "new"] and new.first().by_human


def test_report(spark):
    tag = "array<struct<name string, value string, score double, confidence double>>"
    rows = [("r", 11, 7, None, "Audi", [("taxi", '"yes"', 0.91, None), ("damaged", "no", 0.5, None)]), ("r", 10, 7, None, "BMW", [("Police Car", "true", None, 0.4), ("fleet", "1", 0.1, None), ("fleet", "1", 0.2, None)]), ("r", 3, None, None, "VW", [])]
    labels = spark.createDataFrame(rows, f"run_id string, track_id long, vehicle_index long, api_classification_index int, make string, tags {tag}")
    out = report.report(labels)
    assert out.columns == ["run_id", "track_id", "vehicle_index", "make", "tag_fleet", "tag_fleet_confidence", "tag_police_car", "tag_police_car_confidence"]
    assert [tuple(r)[1:] for r in out.collect()] == [("10", "7", "BMW", "yes", "0.2", "yes", "0.4"), ("3", "", "VW", "", "", "", "")]


def test_suppression_crops_and_cells(spark):
    rows = [("r", 0, i, *b, c, "car") for i, (b, c) in enumerate([((0.0, 0.0, 10.0, 10.0), 0.5), ((0.0, 0.0, 10.0, 9.5), 0.9), ((50.0, 0.0, 60.0, 10.0), 0.1)])]
    d = spark.createDataFrame(rows, "run_id string, frame_index long, pos long, x1 double, y1 double, x2 double, y2 double, confidence double, class_name string").withColumn("bbox", boxes.box("x1", "y1", "x2", "y2"))
    assert [r.pos for r in tracker.suppress(d).orderBy("pos").collect()] == [1, 2]
    crops = spark.createDataFrame([("r", 1, i, i, t, w, 2, s, 0.0, 1.0) for i, (t, w, s) in enumerate([(0.0, 10.0, 1.0), (0.2, 10.0, 5.0), (0.6, 10.0, 3.0), (1.5, 10.0, 3.0)])], "run_id string, track_id long, frame_index long, pos long, t double, width double, tier int, sharpness double, edge_margin double, area double")
    assert [(r.frame_index, r.updates) for r in tracker.select_crops(crops).collect()] == [(2, 2)]
    cells = spark.createDataFrame([("b", 0, 0.0, 0.0, 10.0, 10.0), ("b", 1, 10.0, 0.0, 20.0, 10.0)], "batch_id string, cell long, x1 double, y1 double, x2 double, y2 double")
    users = spark.createDataFrame([("b", 0, 9.0, 0.0, 13.0, 5.0, 0.5), ("b", 1, 1.0, 1.0, 2.0, 2.0, 0.5), ("b", 2, 1.0, 1.0, 3.0, 3.0, 0.4)], "batch_id string, user long, x1 double, y1 double, x2 double, y2 double, confidence double")
    assert sorted((r.cell, r.user) for r in tracker.match_cells(cells, users).collect()) == [(0, 2), (1, 0)]


def test_surer_models_take_cells_first(spark):
    cells = spark.createDataFrame([("b", 0, 0.0, 0.0, 10.0, 10.0)], "batch_id string, cell long, x1 double, y1 double, x2 double, y2 double")
    rows = [("b", 0, 1.0, 1.0, 5.0, 5.0, 0.9, 0.2, 0.9), ("b", 1, 2.0, 2.0, 6.0, 6.0, 0.9, 0.7, None), ("b", 2, 3.0, 3.0, 7.0, 7.0, None, 0.9, 0.9)]
    users = spark.createDataFrame(rows, "batch_id string, user long, x1 double, y1 double, x2 double, y2 double, confidence double, model_confidence double, make_confidence double")
    assert [(r.cell, r.user) for r in tracker.match_cells(cells, users).collect()] == [(0, 1)]


def test_lookup_audit(spark):
    decided = spark.createDataFrame([(1, "exact_match", "reuse", "r1", None, 0), (2, "no_match", "api_fallback", None, None, 0)], "query_id long, reason string, action string, record_id string, distance double, neighbours long")
    queries = spark.createDataFrame([(1, "i", "q"), (2, "j", "q")], "query_id long, image_sha256 string, request_hash string")
    rows = {r.image_sha256: r for r in retrieval.lookup_audit(decided, queries, F.lit("2024-01-02 03:04:05").cast("timestamp")).collect()}
    assert rows["i"].match.record_id == "r1" and rows["i"].match.kind == "exact" and rows["j"].match is None and rows["i"].timestamp.startswith("2024-01-02T03:04:05.000000")


def test_tracks_keep_their_ids(spark):
    rows = [("r", f, n, x, 0.0, x + 20, 20.0, 0.9 if f % 3 else 0.3 if f else 0.9, "car") for f in range(12) for n, x in enumerate([f * 5.0, 300.0 - f * 5.0])]
    d = spark.createDataFrame(rows, "run_id string, frame_index long, pos long, x1 double, y1 double, x2 double, y2 double, confidence double, class_name string").withColumn("bbox", boxes.box("x1", "y1", "x2", "y2"))
    got = {(r.pos, r.track_id) for r in tracker.associate(d).collect()}
    assert got == {(0, 1), (1, 2)}


def test_rescue_gates(spark):
    lost = spark.createDataFrame([("r", 1, 0.0, 0.0, 0.0, 0.0, 20.0), ("r", 2, 0.0, 3.0, 0.0, 0.0, 20.0)], "run_id string, track_id long, t double, x double, y double, vx double, vy double")
    spawns = spark.createDataFrame([("r", 10, 1.0, 0.5, 20.5), ("r", 11, 1.0, 0.0, 80.0), ("r", 12, 2.5, 0.0, 50.0), ("r", 13, 1.0, 0.0, 17.0)], "run_id string, spawn_id long, t double, x double, y double")
    got = {(r.spawn_id, r.track_id): (r.reason, r.chosen) for r in tracker.rescue_pairs(spawns, lost).collect()}
    # without a velocity there is too little history; nearness to the expected place decides, not to the last one
    more = spark.createDataFrame([("r", 5, 0.0, 0.0, 0.0, None, None), ("r", 6, 0.0, 0.0, 10.0, 0.0, 8.0), ("r", 7, 0.0, 0.0, 0.0, 0.0, 20.0)], lost.schema)
    near = {r.track_id: (r.reason, r.chosen) for r in tracker.rescue_pairs(spark.createDataFrame([("r", 20, 1.0, 0.0, 20.0)], spawns.schema), more).collect()}
    assert near == {5: ("history", False), 6: (None, False), 7: (None, True)}
    assert got[10, 1] == (None, True) and got[10, 2] == ("lateral", False) and got[11, 1][0] == "speed" and got[13, 1][0] == "behind" and (12, 1) not in got


def test_edge_filter(spark):
    rows = obs(spark, [(1, 0, 0.0, 100, 50), (2, 0, 0.0, 104, 50), (3, 0, 0.0, 300, 50), (-1, 0, 0.0, 300, 50)])
    kept = filters.drop_edge_observations(rows, rows.where("track_id = 1"), F.lit(False))
    assert [r.track_id for r in kept.collect()] == [3]


DETECTIONS = "run_id string, frame_index long, pos long, x1 double, y1 double, x2 double, y2 double, confidence double, class_name string"


def passing(gone=()):
    return [("r", f, n, x, 0.0, x + 20, 40.0, 0.9, "car") for f in range(12) for n, x in enumerate([f * 5.0, 300.0 - f * 5.0]) if (f, n) not in gone]


def test_lost_tracks_are_taken_over(spark):
    d = spark.createDataFrame(passing({(f, 0) for f in range(4, 8)}) + [("r", 8, 2, 700.0, 0.0, 720.0, 40.0, 0.9, "car")], DETECTIONS).withColumn("bbox", boxes.box("x1", "y1", "x2", "y2"))
    ids = {(r.frame_index, r.pos): r.track_id for r in tracker.associate(d, near=0.9, lost=60, rescue=20).collect()}
    assert ids[11, 0] == ids[0, 0] and ids[8, 2] not in (ids[0, 0], ids[0, 1])


def test_tracking_a_stream_equals_the_batch(spark, tmp_path):
    table = spark.createDataFrame(passing({(5, 0), (6, 0)}), DETECTIONS)
    for part in range(3):
        table.where(F.floor(F.col("frame_index") / 4) == part).coalesce(1).write.json(f"{tmp_path}/in/{part}")
    whole = lambda t: t.withColumn("bbox", boxes.box("x1", "y1", "x2", "y2"))
    stream = whole(spark.readStream.schema(DETECTIONS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*"))
    tracker.associate_stream(stream).writeStream.format("memory").queryName("tracked").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    key = lambda rows: sorted((r.frame_index, r.pos, r.track_id) for r in rows)
    assert key(spark.table("tracked").collect()) == key(tracker.associate(whole(table)).collect())


def test_appearance_and_pixel_gate(spark):
    v = spark.createDataFrame([("r", 1, i, [1.0, float(i)]) for i in range(20)], "run_id string, track_id long, frame_index long, vector array<double>")
    q = spark.createDataFrame([("r", 1, 7, [1.0, 0.0]), ("r", 2, 8, [1.0, 0.0])], "run_id string, track_id long, query_id long, vector array<double>")
    got = {r.query_id: r.cosine for r in tracker.best_similarity(v, q).collect()}
    assert got == {7: pytest.approx(1 / 17**0.5), 8: None}
    cases = spark.createDataFrame([(1, 0.5, 1.0, 10.0, 1.0, 0.9), (3, 0.5, 1.0, 10.0, 50.0, 0.9), (3, 0.5, 25.0, 10.0, 1.0, 0.9), (3, 0.5, 1.0, 10.0, 1.0, None), (3, 0.5, 19.0, 10.0, 1.0, 0.7)], "n int, gap double, d double, h double, v double, c double")
    assert [r.why for r in cases.select(tracker.pixel_reason(*[F.col(c) for c in ("n", "gap", "d", "h", "v", "c")]).alias("why")).collect()] == ["history", "speed", "distance", "appearance", None]


def test_cells_of_a_composite(spark):
    cell = boxes.box(F.lit(100.0), F.lit(0.0), F.lit(200.0), F.lit(100.0))
    placed = boxes.fitted_into(F.lit(400.0), F.lit(200.0), cell)
    r = spark.range(1).select(placed.alias("p"), boxes.out_of_cell(boxes.box(F.lit(125.0), F.lit(25.0), F.lit(300.0), F.lit(50.0)), placed, F.lit(400.0), F.lit(200.0)).alias("o"), report.request({"b": 1, "a": "x"}, F.lit("i.jpg")).alias("q")).first()
    assert tuple(r.p) == (100, 25, 200, 75) and tuple(r.o) == (100, 0, 400, 100) and r.q == '{"a":"x","b":1,"image":"i.jpg"}'
