from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from velograph.operators import overlay, tracker, upkeep
from velograph.sources import pictures, video

SQUARE = [(2, 1), (5, 1), (5, 4), (2, 4)]
FRAME = "id long, image struct<height:int,width:int,nChannels:int,data:binary>"


def box(kind: bytes, body: bytes, wide: bool = False) -> bytes:
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body if wide else struct.pack(">I4s", len(body) + 8, kind) + body


def track(handler: bytes, scale: int, runs: list[tuple[int, int]], size=(640, 360), version: int = 0) -> bytes:
    clock = bytes([version, 0, 0, 0]) + (bytes(16) if version else bytes(8)) + struct.pack(">I", scale)
    entry = bytes(8) + bytes(6) + struct.pack(">H", 1) + bytes(16) + struct.pack(">HH", *size) + bytes(50)
    entry = struct.pack(">I", len(entry)) + b"avc1" + entry[8:]
    times = bytes(4) + struct.pack(">I", len(runs)) + b"".join(struct.pack(">II", *r) for r in runs)
    table = box(b"stbl", box(b"stsd", bytes(4) + struct.pack(">I", 1) + entry) + box(b"stts", times))
    return box(b"trak", box(b"mdia", box(b"hdlr", bytes(8) + handler + bytes(12)) + box(b"mdhd", clock + bytes(8)) + box(b"minf", table)))


def test_video_headers(spark, tmp_path):
    sound = track(b"soun", 48_000, [(10, 1024)])
    for version in (0, 1):
        movie = box(b"moov", box(b"free", b"") + sound + track(b"vide", 30_000, [(100, 1001), (20, 1001)], version=version))
        (tmp_path / "a.mp4").write_bytes(box(b"ftyp", b"isom") + box(b"mdat", bytes(5000), wide=True) + movie)
        found = video.video_metadata(spark, f"file://{tmp_path}/a.mp4")
        assert (found.width, found.height, found.frames) == (640, 360, 120) and abs(found.fps - 30_000 / 1001) < 1e-9
    (tmp_path / "b.mp4").write_bytes(box(b"moov", sound))
    with pytest.raises(ValueError, match="no video track"):
        video.video_metadata(spark, f"{tmp_path}/b.mp4")
    (tmp_path / "c.mp4").write_bytes(movie[:-10])
    with pytest.raises(ValueError, match="does not fit"):
        video.video_metadata(spark, f"{tmp_path}/c.mp4")
    (tmp_path / "d.mp4").write_bytes(box(b"moov", track(b"vide", 30, [])))
    assert video.video_metadata(spark, f"{tmp_path}/d.mp4") == video.VideoMetadata(640, 360, 0.0, 0)
    assert video.first_frame(spark.createDataFrame([(5, "b"), (3, "a")], "frame_index long, p string")).first().p == "a"
    with pytest.raises(ValueError, match="no frame"):
        video.first_frame(spark.createDataFrame([], "frame_index long"))


def test_polygon_cut(spark):
    pixels = np.arange(1, 8 * 6 * 3 + 1, dtype=np.uint8).reshape(6, 8, 3)
    rows = spark.createDataFrame([(1, (6, 8, 3, bytearray(pixels.tobytes()))), (2, None)], FRAME)
    found = {r.id: r for r in pictures.cut_to_polygon(rows, SQUARE).collect()}
    assert pictures.polygon_rect(SQUARE) == (2, 1, 4, 4) and found[2].image is None
    one = found[1]
    assert (one.image.width, one.image.height, one.offset.x, one.offset.y) == (4, 4, 2, 1)
    assert np.array_equal(np.frombuffer(one.image.data, np.uint8).reshape(4, 4, 3), pixels[1:5, 2:6])
    triangle = [(0, 0), (7, 0), (0, 5)]
    data = np.frombuffer(pictures.cut_to_polygon(rows.where("id = 1"), triangle).first().image.data, np.uint8).reshape(6, 8, 3)
    assert np.array_equal(data[0], pixels[0]) and not data[5, 1:].any() and np.array_equal(data[:, 0], pixels[:, 0])
    beyond = pictures.cut_to_polygon(rows.where("id = 1"), [(20, 20), (30, 20), (30, 30)]).first()
    assert (beyond.image.width, beyond.image.height) == (0, 0)


def test_files_of_pictures(spark, tmp_path):
    crops = spark.createDataFrame([(3, "x/track_1.png", bytearray(b"a")), (None, "y.jpg", bytearray(b"b")), (12, "noname", bytearray(b"c"))], "vehicle_index int, source string, content binary")
    named = pictures.vehicle_pictures(crops)
    pictures.write_pictures(named, str(tmp_path))
    assert {p.name: p.read_bytes() for p in tmp_path.iterdir()} == {"vehicle_000003.png": b"a", "vehicle_000012.jpg": b"c"}
    again = named.withColumn("content", F.lit(b"z"))
    pictures.write_pictures(again, str(tmp_path), replace=False)
    assert (tmp_path / "vehicle_000003.png").read_bytes() == b"a"
    pictures.write_pictures(again, str(tmp_path))
    assert (tmp_path / "vehicle_000003.png").read_bytes() == b"z"
    grids = spark.createDataFrame([("k", bytearray(b"jpg"), '{"a":1}'), ("e", bytearray(b""), None)], "key string, content binary, request string")
    cells = spark.createDataFrame([("k", 1, "q.jpg", (0.0, 1.0), (2.0, 3.0)), ("k", 0, "p.jpg", (0.0, 1.0), (2.0, 3.0))], "key string, index int, source_image string, cell_box struct<x:double,y:double>, content_box struct<x:double,y:double>")
    made = {r.path: bytes(r.content) for r in pictures.grid_manifests(cells, grids).collect()}
    assert set(made) == {"k.jpg", "k.json", "e.jpg", "e.json"} and made["e.json"] == b'{"image":"e.jpg","request":null,"cells":[]}'
    assert made["k.json"].startswith(b'{"image":"k.jpg","request":{"a":1},"cells":[{"index":0,"source_image":"p.jpg"')


def test_texts_that_fit(spark):
    rows = spark.createDataFrame([("abc",), ("abcdefgh",), ("ab cdefgh",), (None,), ("",)], "t string")
    at = lambda limit: [r[0] for r in rows.select(overlay.truncated(F.col("t"), limit, len)).collect()]
    assert at(6) == ["abc", "abc...", "ab...", None, ""] and at(3) == ["abc", "...", "...", None, ""]
    assert at(2) == ["", "", "", None, ""] and at(0) == ["", "", "", None, ""]


def test_eased_rows(spark):
    shown = [(f, m, p, n, q) for f, m, p, n, q in [(0, "A", 0, 1, 1.0), (3, "A", 0, 1, 1.0), (7, "A", 1, 1, 0.5), (7, "B", 0, 2, 1.0), (9, "B", 0, 3, 2.0), (11, "A", 0, 3, 1.0)]]
    rows = spark.createDataFrame([("r", *s) for s in shown], "run_id string, frame_index long, make string, place int, n long, progress double")
    got = {(r.frame_index, r.make): (round(r.y, 4), round(r.progress, 4), r.pulse) for r in overlay.eased(rows, 10.0).collect()}
    assert got[0, "A"] == (6.5, 0.3, 8) and got[3, "A"] == (4.225, 0.51, 7) and got[7, "A"] == (6.2462, 0.507, 6)
    assert got[7, "B"] == (6.5, 0.3, 8) and got[9, "B"] == (4.225, 0.51, 8)
    assert got[11, "A"] == (6.5, 0.3, 8)  # not shown at 9


def test_upkeep(spark):
    schema = "record_id string, image_sha256 string, embedding_model string, embedding array<double>, supersedes_record_id string"
    records = spark.createDataFrame([("a", "i", "old", [1.0, 2.0], None), ("b", "j", "new", [1.0, 2.0], None), ("c", "k", "new", None, None), ("d", "l", "new", [1.0], "e"), ("e", "i", "old", None, None)], schema)
    vectors = spark.createDataFrame([("i", [5.0, 6.0]), ("i", [5.0, 6.0]), ("k", [1.0]), ("l", [7.0, 8.0])], "image_sha256 string, embedding array<double>")
    new = upkeep.migrated(records, vectors, "new", 2)
    assert sorted((r.supersedes_record_id, r.embedding, r.embedding_model) for r in new.collect()) == [("a", [5.0, 6.0], "new"), ("d", [7.0, 8.0], "new")]
    assert tuple(upkeep.migration_summary(records, new, "new", 2).first()) == (2, 1)
    after = records.unionByName(new)
    assert [r.record_id for r in upkeep.outdated(after, "new", 2).collect()] == ["c"]
    assert upkeep.migrated(after, vectors, "new", 2).count() == 0
    empty = spark.createDataFrame([], schema)
    assert upkeep.migrated(empty, vectors, "new", 2).count() == 0 and tuple(upkeep.migration_summary(empty, empty, "new", 2).first()) == (0, 0)
    held = spark.createDataFrame([(1, "x"), (2, None)], "key int, body string")
    older = spark.createDataFrame([(2, "y"), (3, "z"), (3, "z")], "key int, body string")
    assert sorted(upkeep.organized(held, older).collect(), key=lambda r: r.key) == [(1, "x"), (2, None), (3, "z")]
    kept = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "record_id string, result string")
    repaired = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None), ("z", "9")], "record_id string, result string")
    assert sorted(tuple(r) for r in upkeep.compacted(kept, repaired).collect()) == [("a", "1", False), ("b", "2", True), ("c", None, True)]


def test_rescue_events(spark):
    lost = spark.createDataFrame([("r", 1, 0.0, 0.0, 0.0, 1.0, 0.0), ("r", 2, 0.0, 0.0, 0.5, 1.0, 0.0), ("r", 3, 0.0, 0.0, 0.0, None, None)], "run_id string, track_id long, t double, x double, y double, vx double, vy double")
    spawns = spark.createDataFrame([("r", 9, 1.0, 1.0, 0.0)], "run_id string, spawn_id long, t double, x double, y double")
    found = {r.old_track_id: r for r in upkeep.rescue_events(tracker.rescue_pairs(spawns, lost)).collect()}
    assert set(found) == {1, 3} and found[1].outcome == "accepted" and found[1].implied_speed == 1.0
    assert (found[1].distance, found[1].lateral, found[1].reason) == (0.0, 0.0, None)  # to where it was expected
    assert tuple(found[3])[1:2] == ("rejected",) and (found[3].reason, found[3].distance, found[3].implied_speed, found[3].lateral) == ("insufficient_history", None, None, None)


def test_reasons_of_rescue_events(spark):
    """What was measured before a test that failed is there, what comes after it is not."""
    lost = [("r", 1, 0.0, 0.0, 0.0, 2.0, 0.0), ("r", 2, 0.0, 0.0, 50.0, 2.0, 0.0), ("r", 3, 0.0, 3.0, 6.0, 0.0, 0.0), ("r", 4, 0.0, 0.0, 2.5, 2.0, 0.0), ("r", 5, 0.0, 3.0, 0.0, 1.5, 0.0)]
    lost = spark.createDataFrame(lost, "run_id string, track_id long, t double, x double, y double, vx double, vy double")
    spawns = spark.createDataFrame([("r", 9, 1.0, 2.0, 0.0, 0.5)], "run_id string, spawn_id long, t double, x double, y double, cosine double")
    found = {r.old_track_id: (r.reason, r.distance, r.lateral, r.appearance_similarity) for r in upkeep.rescue_events(tracker.rescue_pairs(spawns, lost)).collect()}
    assert found == {1: ("appearance_mismatch", 0.0, 0.0, 0.5), 2: ("speed_exceeded", 50.0, None, None), 3: ("distance_exceeded", pytest.approx(37**0.5), None, None), 4: ("lateral_exceeded", 2.5, 2.5, None), 5: ("behind_prediction", 2.5, 0.0, None)}


def test_duplicate_audit(spark):
    kind = "run_id string, a_track_id long, b_track_id long, a_vehicle_index long, b_vehicle_index long, identity_match boolean, gap double, error double, width_ratio double, height_ratio double, iou double, speed double, passes boolean"
    pairs = spark.createDataFrame([("r", 1, 2, 3, 4, True, 0.5, 0.1, 0.9, 0.8, 0.7, None, True), ("r", 1, 5, 3, 6, False, 0.5, 9.0, 0.9, 0.8, 0.0, 1.0, False), ("r", 1, 7, 3, 8, None, None, None, None, None, None, None, None)], kind)
    rows = [r.asDict() for r in upkeep.duplicate_audit(pairs).collect()]
    assert rows == [{"run_id": "r", "from_track_id": 1, "to_track_id": 2, "from_vehicle_index": 3, "to_vehicle_index": 4, "identity_match": True, "gap": 0.5, "error": 0.1, "width_ratio": 0.9, "height_ratio": 0.8, "iou": 0.7, "speed": None}]
    assert upkeep.duplicate_audit(pairs.limit(0)).collect() == []
