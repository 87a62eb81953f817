"""Frames of AVI files that need no decoder (Motion-JPEG and raw pictures), as a data source that Spark splits, and a sink.

A file is read by its chunks: the driver walks over their headers and deals the frames into ranges, and each task reads the
bytes of its own.  Filters on ``frame_index`` reach the source, so ranges that they rule out are not dealt at all.  Frames
end at the first that cannot be one: a chunk that the file ends in, an empty one, a JPEG without its marks or a raw picture
of another size.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Frames of a partition, unless the option ``frames`` says otherwise.
FRAMES = 512
SCHEMA = "path string, frame_index long, t double, width int, height int, content binary"


def _open(path: str):
    system, name = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))
    return system.open_input_file(name)


class Layout:
    """What the headers of a file say, and where its frames are: (offset, size) each."""

    def __init__(self, file):
        self.length = file.size()
        self.file = file
        self.fps, self.width, self.height, self.kind = 0.0, 0, 0, b""
        self.frames: list[tuple[int, int]] = []
        if self._read(0, 4) != b"RIFF" or self._read(8, 4) != b"AVI ":
            raise ValueError("not an AVI file")
        self._walk(12, self.length)
        del self.file

    def _read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _walk(self, at: int, end: int) -> bool:
        """Whether frames may go on behind ``end``."""
        while at + 8 <= min(end, self.length):
            name, size = struct.unpack("<4sI", self._read(at, 8))
            body = at + 8
            if name == b"LIST" and self._read(body, 4) in (b"hdrl", b"strl", b"movi", b"rec "):
                if not self._walk(body + 4, body + size):
                    return False
            elif name == b"strh" and self._read(body, 4) == b"vids":
                scale, rate = struct.unpack("<II", self._read(body + 20, 8))
                self.fps = rate / scale if scale else 0.0
            elif name == b"strf" and not self.width:
                self.width, self.height = (abs(x) for x in struct.unpack("<ii", self._read(body + 4, 8)))
                self.kind = self._read(body + 16, 4)
            elif re.fullmatch(rb"\d\dd[bc]", name):
                if not self._is_frame(body, size):
                    return False
                self.frames.append((body, size))
            at = body + size + size % 2
        return True

    def _is_frame(self, body: int, size: int) -> bool:
        if not size or body + size > self.length:
            return False
        if self.kind.upper() == b"MJPG":
            return size >= 4 and self._read(body, 2) == b"\xff\xd8" and b"\xff\xd9" in self._read(body + max(0, size - 4), 4)
        return size == (self.width * 3 + 3) // 4 * 4 * self.height


class Range(InputPartition):
    def __init__(self, path: str, first: int, fps: float, width: int, height: int, places: list[tuple[int, int]]):
        self.path, self.first, self.fps, self.width, self.height, self.places = path, first, fps, width, height, places


class AviReader(DataSourceReader):
    def __init__(self, paths: list[str], frames: int):
        self.paths, self.frames = paths, frames
        self.low, self.high = 0, 1 << 62
        self.only: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of ``frame_index`` with numbers narrow the range; Spark tests all filters again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_index",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
                elif isinstance(f, (EqualTo, In)):
                    wanted = set(f.value) if isinstance(f, In) else {f.value}
                    self.only = wanted if self.only is None else self.only & wanted
            yield f

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            with _open(path) as file:
                layout = Layout(file)
            if layout.frames and layout.fps <= 0:
                raise ValueError(f"{path} has no frame rate")
            last = min(self.high, len(layout.frames))
            for at in range(self.low, last, self.frames):
                end = min(at + self.frames, last)
                if self.only is None or any(at <= i < end for i in self.only):
                    out.append(Range(path, at, layout.fps, layout.width, layout.height, layout.frames[at:end]))
        return out

    def read(self, partition: Range | None) -> Iterator[tuple]:
        if partition is None:  # Spark's way to read no partitions
            return
        with _open(partition.path) as file:
            for i, (at, size) in enumerate(partition.places, partition.first):
                file.seek(at)
                yield partition.path, i, i / partition.fps, partition.width, partition.height, bytes(file.read(size))


class AviSource(DataSource):
    """``spark.read.format("avi").option("paths", ...)``: paths separated by line breaks, frames in ``frames`` a partition."""

    @classmethod
    def name(cls) -> str:
        return "avi"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AviReader:
        paths = [p for p in (self.options.get("paths") or self.options.get("path") or "").split("\n") if p]
        return AviReader(paths, int(self.options.get("frames", FRAMES)))


def read_frames(spark: SparkSession, paths: list[str], frames: int = FRAMES) -> DataFrame:
    """(path, frame_index, t, width, height, content) of the files' frames; a file without frames gives none."""
    spark.dataSource.register(AviSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("avi").option("paths", "\n".join(paths)).option("frames", frames).load()


def _head(width: int, height: int, fps: float, count: int, size: int) -> bytes:
    """The file up to the first frame, of ``count`` frames whose chunks take ``size`` bytes."""
    chunk = lambda name, body: name + struct.pack("<I", len(body)) + body
    rate = round(fps * 1000)
    main = struct.pack("<14I", round(1e6 / fps), 0, 0, 0x10, count, 0, 1, 0, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1000, rate, 0, count, 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    lists = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", stream) + chunk(b"strf", form)))
    index = 8 + 16 * count
    return b"RIFF" + struct.pack("<I", 4 + len(lists) + 12 + size + index) + b"AVI " + lists + b"LIST" + struct.pack("<I", 4 + size) + b"movi"


def write_frames(frames: DataFrame, folder: str, fps: float, width: int, height: int) -> DataFrame:
    """(run_id, path, frames): one Motion-JPEG file for each run of ``frames`` (run_id, frame_index, content: a JPEG).

    A run's frames are sorted and stream into its file one after the other, so a task holds one at a time; a file is written
    beside its place and moved there when it is whole, and a task that is run again makes the same file.  ``folder`` is one
    that all executors reach.  Null contents are left out; files of up to 4 GB.
    """
    own = frames.where("content is not null").select(F.col("run_id").cast("string").alias("run_id"), F.col("frame_index").cast("long").alias("frame_index"), "content")
    size = F.octet_length("content")
    totals = own.groupBy("run_id").agg(F.count("*").alias("n"), F.sum(8 + size + size % 2).alias("size"))
    rows = own.join(totals, "run_id").repartition("run_id").sortWithinPartitions("run_id", "frame_index")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = None
        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None or out.run_id != r.run_id:
                    out = _File(folder, r.run_id, _head(width, height, fps, r.n, r.size))
                out.add(r.content)
                if len(out.index) == r.n:
                    yield pd.DataFrame({"run_id": [r.run_id], "path": [out.close()], "frames": [r.n]})

    return rows.mapInPandas(run, "run_id string, path string, frames long")


class _File:
    """A file that grows by frames; its index comes last."""

    def __init__(self, folder: str, run_id: str, head: bytes):
        self.run_id, self.index, self.at = run_id, [], 4
        self.path = f"{folder}/{re.sub('[^A-Za-z0-9._-]', '_', run_id)}.avi"
        self.system, name = fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", self.path))
        self.name, self.beside = name, f"{name}.part"
        self.system.create_dir(name.rpartition("/")[0], recursive=True)
        self.stream = self.system.open_output_stream(self.beside)
        self.stream.write(head)

    def add(self, content: bytes) -> None:
        self.index.append((self.at, len(content)))
        self.stream.write(b"00dc" + struct.pack("<I", len(content)) + bytes(content) + b"\0" * (len(content) % 2))
        self.at += 8 + len(content) + len(content) % 2

    def close(self) -> str:
        self.stream.write(b"idx1" + struct.pack("<I", 16 * len(self.index)) + b"".join(b"00dc" + struct.pack("<III", 0x10, at, size) for at, size in self.index))
        self.stream.close()
        self.system.move(self.beside, self.name)
        return self.path
