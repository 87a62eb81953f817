"""AVI frames: written, read in parts, pruned, and cut where they end."""

from __future__ import annotations

import struct

import pytest
from pyspark.sql import functions as F

from velograph.sources.avi import read_frames, write_frames


def jpeg(i):
    return b"\xff\xd8" + bytes([i % 256]) * (i % 7 + 1) + b"\xff\xd9"


@pytest.fixture
def files(spark, tmp_path):
    rows = [(run, i, jpeg(i + k)) for k, run in enumerate(("a", "b c")) for i in range(40 - 9 * k)]
    frames = spark.createDataFrame(rows + [("a", 100, None)], "run_id string, frame_index long, content binary").orderBy(F.rand(1))
    made = {r.run_id: r for r in write_frames(frames, f"file:{tmp_path}/out", 12.5, 64, 48).collect()}
    assert {k: r.frames for k, r in made.items()} == {"a": 40, "b c": 31}
    return made


def test_parts_equal_one(spark, files):
    paths = [files["a"].path, files["b c"].path]
    whole = [tuple(r) for r in read_frames(spark, paths).orderBy("path", "frame_index").collect()]
    parts = read_frames(spark, paths, frames=7)
    assert parts.rdd.getNumPartitions() == 6 + 5
    assert [tuple(r) for r in parts.orderBy("path", "frame_index").collect()] == whole and len(whole) == 71
    for _, i, t, width, height, content in whole:
        assert t == i / 12.5 and (width, height) == (64, 48)
    assert [r[5] for r in whole[:40]] == [jpeg(i) for i in range(40)]


def test_ranges_reach_the_source(spark, files):
    rows = read_frames(spark, [files["a"].path], frames=5)
    some = rows.where((F.col("frame_index") >= 12) & (F.col("frame_index") < 21))
    assert some.rdd.getNumPartitions() == 2 and sorted(r.frame_index for r in some.collect()) == list(range(12, 21))
    assert rows.where("frame_index = 33").rdd.getNumPartitions() == 1 and rows.where("frame_index in (1, 2, 39)").rdd.getNumPartitions() == 2
    assert rows.where("frame_index > 50").collect() == [] and rows.where("frame_index > 5 and t < 1").count() == 7


def test_frames_end_where_they_cannot_be_read(spark, files, tmp_path):
    data = open(files["a"].path.removeprefix("file:"), "rb").read()
    chunks = [data.index(b"00dc")]
    while len(chunks) < 40:
        size = struct.unpack("<I", data[chunks[-1] + 4 : chunks[-1] + 8])[0]
        chunks.append(chunks[-1] + 8 + size + size % 2)

    def count(name, content):
        path = tmp_path / name
        path.write_bytes(content)
        return read_frames(spark, [str(path)]).count()

    assert count("cut", data[: chunks[20] + 10]) == 20 and count("torn", data[: chunks[20] + 5]) == 20 and count("head", data[: chunks[0]]) == 0
    broken = bytearray(data)
    broken[chunks[5] + 8] = 0
    assert count("broken", bytes(broken)) == 5
    raw = bytearray(data.replace(b"MJPG", b"\0\0\0\0"))
    assert count("raw", bytes(raw)) == 0  # no chunk has the size of a picture
    with pytest.raises(Exception, match="not an AVI file"):
        count("other", b"RIFF\0\0\0\0WAVE" + data[12:])
