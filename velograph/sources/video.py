"""What a video's header says, read without a decoder, and the frame that others are measured against."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from velograph.sources.sinks import _fs

Read = Callable[[int, int], bytes]


@dataclass(frozen=True)
class VideoMetadata:
    width: int
    height: int
    fps: float
    frames: int


def _parts(read: Read, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of what the boxes of an MP4 or QuickTime file from ``start`` to ``end`` hold."""
    while start + 8 <= end:
        size, kind = struct.unpack(">I4s", read(start, 8))
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", read(start + 8, 8))[0], 16
        size = size or end - start  # 0: up to the end
        if size < head or start + size > end:
            raise ValueError(f"a box at {start} does not fit its file")
        yield kind, start + head, start + size
        start += size


def _part(read: Read, start: int, end: int, *path: bytes) -> tuple[int, int]:
    for wanted in path:
        found = next(((a, b) for kind, a, b in _parts(read, start, end) if kind == wanted), None)
        if found is None:
            raise ValueError(f"no {wanted.decode()} in the video")
        start, end = found
    return start, end


def parse_header(read: Read, length: int) -> VideoMetadata:
    """Of the first video track: the size of its samples, their number, and their number a second (0.0 if unknown)."""
    movie = _part(read, 0, length, b"moov")
    for kind, a, b in _parts(read, *movie):
        if kind != b"trak":
            continue
        handler, _ = _part(read, a, b, b"mdia", b"hdlr")
        if read(handler + 8, 4) != b"vide":
            continue
        clock, _ = _part(read, a, b, b"mdia", b"mdhd")
        scale = struct.unpack(">I", read(clock + (20 if read(clock, 1)[0] == 1 else 12), 4))[0]
        table = _part(read, a, b, b"mdia", b"minf", b"stbl")
        entry, _ = _part(read, *table, b"stsd")
        width, height = struct.unpack(">HH", read(entry + 8 + 32, 4))
        times, _ = _part(read, *table, b"stts")
        n = struct.unpack(">I", read(times + 4, 4))[0]
        runs = list(struct.iter_unpack(">II", read(times + 8, 8 * n))) if n else []
        frames, lasting = sum(c for c, _ in runs), sum(c * d for c, d in runs)
        return VideoMetadata(width, height, frames * scale / lasting if lasting else 0.0, frames)
    raise ValueError("no video track")


def video_metadata(spark: SparkSession, path: str) -> VideoMetadata:
    """The header of an MP4 or QuickTime file in any store that Spark reads; only headers are read, not the pictures."""
    fs, at = _fs(spark, path)
    length = fs.getFileStatus(at).getLen()
    stream = fs.open(at)

    def read(start: int, n: int) -> bytes:
        if start + n > length:
            raise ValueError("the video's header is cut")
        stream.seek(start)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

    try:
        return parse_header(read, length)
    finally:
        stream.close()


def first_frame(frames: DataFrame) -> DataFrame:
    """The frame with the least frame_index; that there is none is an error."""
    first = frames.orderBy("frame_index").limit(1)
    if first.isEmpty():
        raise ValueError("the video has no frame")
    return first
