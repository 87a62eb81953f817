from __future__ import annotations

import json
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from velograph.operators import tracks
from velograph.plans import queries
from velograph.sources import readers, sinks
from velograph.streaming.counting import track_states, windowed_counts


def test_sampling_equals_a_clock(spark):
    for source, target in ((30.0, 10.0), (29.97, 10.0), (25.0, 30.0), (59.94, 7.0)):
        want, due = [], 0.0
        for i in range(700):
            if i / source + 1e-9 >= due:
                want.append(i)
                due += 1 / min(source, target)
        got = [r.frame_index for r in readers.sampled_frames(spark, 700, source, target).orderBy("frame_index").collect()]
        assert got == want
    assert readers.sampled_frames(spark, 10, 30, 10, terminal=True).orderBy(F.desc("frame_index")).first().frame_index == 9
    with pytest.raises(ValueError):
        readers.sampled_frames(spark, 10, 0, 10)


def test_json_sources(spark, tmp_path):
    assert readers.read_lines(spark, f"{tmp_path}/none.jsonl", "a int").count() == 0
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert sorted(r.a for r in readers.read_lines(spark, f"{tmp_path}/rows.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"a":\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_lines(spark, f"{tmp_path}/bad.jsonl", "a int").collect()
    (tmp_path / "labels.json").write_text(json.dumps({"7": {"make": "Audi"}, "9": {"make": None}}))
    assert sorted((r.track_id, r.make) for r in readers.read_keyed_document(spark, f"{tmp_path}/labels.json", "struct<make string>").collect()) == [(7, "Audi"), (9, None)]
    assert readers.read_keyed_document(spark, f"{tmp_path}/no.json", "struct<make string>").count() == 0
    assert readers.effective(spark, f"{tmp_path}/no.json", "raw") == "raw"


def test_csv_dimensions(spark, tmp_path):
    (tmp_path / "p.csv").write_text("make,model,generation,variation,powertrain\nA,B,C,,BEV\nA,B,C,,MIXED\n")
    assert [tuple(r) for r in readers.read_powertrains(spark, f"{tmp_path}/p.csv").collect()] == [("A", "B", "C", "", "MIXED")]
    (tmp_path / "q.csv").write_text("make,model,generation,variation,powertrain\nA,B,C,,STEAM\n")
    with pytest.raises(Exception, match="unknown powertrain"):
        readers.read_powertrains(spark, f"{tmp_path}/q.csv").collect()
    with pytest.raises(ValueError, match="no column"):
        readers.read_countries(spark, f"{tmp_path}/q.csv")


def test_replacing_keeps_the_old_table_on_failure(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace(spark.range(3).toDF("a"), path)
    with pytest.raises(Exception, match="stop"):
        sinks.replace(spark.range(2).select(F.raise_error(F.lit("stop")).cast("int").alias("a")), path)
    assert spark.read.json(path).count() == 3 and len(list(tmp_path.iterdir())) <= 2
    sinks.replace(spark.range(5).toDF("a"), path)
    assert spark.read.json(path).count() == 5


def test_runs_are_published_whole(spark, tmp_path):
    root, manifest = f"{tmp_path}/run1", {"video_path": "v.mp4", "camera_id": "c"}
    run = sinks.RunTransaction(spark, root, manifest)
    run.write("tracks", spark.range(2))
    run.publish(("tracks",))
    for other, overwrite in ((manifest, False), ({"video_path": "w.mp4", "camera_id": "c"}, True)):
        again = sinks.RunTransaction(spark, root, other, overwrite)
        again.write("tracks", spark.range(9))
        with pytest.raises(ValueError):
            again.publish(("tracks",))
    assert spark.read.json(f"{root}/tracks").count() == 2 and [p.name for p in tmp_path.iterdir() if "staging" in p.name] == []
    again = sinks.RunTransaction(spark, root, manifest, True)
    again.write("tracks", spark.range(9))
    again.publish(("tracks",))
    assert spark.read.json(f"{root}/tracks").count() == 9
    with pytest.raises(ValueError, match="not written"):
        sinks.RunTransaction(spark, f"{tmp_path}/run2", manifest).publish(("tracks",))


def test_run_names(spark, tmp_path):
    now = datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC)
    names = [sinks.allocate_run(spark, str(tmp_path), "/a/clip.mp4", "cam", now).rsplit("/", 1)[-1] for _ in range(2)]
    assert names == ["clip--camera-cam--20240506-070809Z", "clip--camera-cam--20240506-070809Z--02"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("r", k, i, i, t, float(x), 0.0, i >= 2) for k, steps in {1: [(0.0, 0), (0.2, 1), (0.4, 2), (0.5, 3)], 2: [(0.0, 0), (0.1, 1), (3.0, 2), (3.1, 3)], 3: [(0.0, 0), (1.0, 30), (1.2, 31), (1.3, 32)]}.items() for i, (t, x) in enumerate(steps)]
    schema = "run_id string, track_id long, frame_index long, pos long, t double, x double, y double, inside_roi boolean"
    table = spark.createDataFrame(rows, schema)
    for part in range(2):
        table.where(F.floor(F.col("frame_index") / 2) == part).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    q = track_states(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.track_id, r.frame_index): r.counted for r in spark.table("states").where("not retired").collect()}
    kept = tracks.counted_in_zone(tracks.retire_stale(table, F.col("x"), F.col("y")))
    assert got == {(r.track_id, r.frame_index): r.counted for r in kept.collect()}


def test_sides_of_a_line_are_state_and_tracks_are_forgotten(spark, tmp_path):
    schema = "run_id string, track_id long, frame_index long, pos long, t double, x double, y double, inside_roi boolean, ts timestamp"
    at = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = [[("r", 1, 0, 0, 0.0, 5.0, -3.0, True, at(0)), ("r", 2, 0, 1, 0.0, 5.0, 3.0, True, at(0))], [("r", 1, 1, 2, 0.1, 5.0, 3.0, True, at(1)), ("r", 2, 1, 3, 0.1, 5.0, -3.0, True, at(1))], [("r", 3, 9, 4, 0.9, 5.0, 1.0, True, at(500))], [("r", 4, 10, 6, 1.0, 5.0, 1.0, True, at(550))], [("r", 1, 11, 5, 1.1, 5.0, -3.0, True, at(600))]]
    for n, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.json(f"{tmp_path}/in/{n}")
        time.sleep(1.1)  # files are taken by their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*").withWatermark("ts", "1 second")
    made = track_states(stream, line=((0.0, 0.0), (10.0, 0.0)), direction="A_TO_B", after=1e9, ttl_ms=60_000)
    q = made.writeStream.format("memory").queryName("sides").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.pos: (r.crossing, r.counted) for r in spark.table("sides").collect()}
    # the last row comes after its track was forgotten, so it begins anew on its side
    assert got == {0: (None, False), 1: (None, False), 2: ("A_TO_B", True), 3: ("B_TO_A", False), 4: (None, False), 5: (None, False), 6: (None, False)}


def test_windows_count_late_rows(spark):
    rows = spark.createDataFrame([("car", datetime(2024, 1, 1, 0, 10)), ("car", datetime(2024, 1, 1, 0, 50)), ("bus", datetime(2024, 1, 1, 1, 0))], "class_name string, ts timestamp")
    assert sorted((r.class_name, r.window_start.hour, r.n) for r in windowed_counts(rows).collect()) == [("bus", 1, 1), ("car", 0, 2)]


def test_every_query_has_a_name_and_most_have_sql():
    names, sql = queries.queries(), queries.oracle_sql()
    assert set(sql) <= set(names) and len(sql) >= 40
