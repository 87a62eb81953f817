"""Writers: whole tables that replace each other at once, versions that are published together, appends, the CSV report, runs."""

from __future__ import annotations

import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from velograph.sources.readers import exists


CALIBRATION = "created_at string, embedding_model string, embedding_dimensions int, bits int, same_pairs long, conflict_pairs long, max_same double, min_conflict double, threshold double"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def replace(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write beside ``path`` and then take its place; if writing fails, what was there stays."""
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    staged = f"{path}.{uuid.uuid4().hex}"
    try:
        df.write.format(kind).save(staged)
    except Exception:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(staged), True)
        raise
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{staged}.old")
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{path} could not be replaced")
    if had:
        fs.delete(old, True)


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, folder) of the versions of ``root`` whose manifests are whole, newest first."""
    fs, at = _fs(spark, f"{root}/_versions")
    if not fs.exists(at):
        return []
    found = []
    for status in sorted(fs.listStatus(at), key=lambda s: s.getPath().getName(), reverse=True):
        stream = fs.open(status.getPath())
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        if text.endswith("\n"):
            found.append((int(status.getPath().getName()), text.strip()))
    return found


def _switch(spark: SparkSession, root: str, folder: str) -> int:
    """Make ``folder`` the newest version by creating the next manifest; whoever comes second takes the number after."""
    fs, at = _fs(spark, f"{root}/_versions")
    fs.mkdirs(at)
    number = max((int(s.getPath().getName()) for s in fs.listStatus(at)), default=0)
    while True:
        number += 1
        try:
            stream = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_versions/{number:012d}"), False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                continue
            raise
        stream.write(bytearray(f"{folder}\n".encode()))
        stream.close()
        return number


def publish(tables: dict[str, DataFrame], root: str, kind: str = "parquet", keep: int = 2) -> int:
    """Write tables side by side under ``root`` and make them its current version together; the number of the version.

    Nothing is renamed: a version is a folder of its own, and becomes current by the creation of one small manifest, so a
    reader finds the version before or this one and never none, and a failure at any step leaves the one before.  Of
    writers at the same time each gets a version and the later is current.  ``keep`` versions stay, for readers that have
    begun; older ones are deleted.  The file system's create has to refuse what exists.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.format(kind).save(f"{root}/{folder}/{name}")
        number = _switch(spark, root, folder)
    except Exception:
        fs, at = _fs(spark, f"{root}/{folder}")
        fs.delete(at, True)
        raise
    for old, gone in _versions(spark, root)[keep:]:
        fs, at = _fs(spark, f"{root}/_versions/{old:012d}")
        fs.delete(at, False)
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{gone}"), True)
    return number


def current(spark: SparkSession, root: str, name: str) -> str | None:
    """The path of a table in the current version of ``root``; None before the first."""
    found = _versions(spark, root)
    return f"{root}/{found[0][1]}/{name}" if found else None


def save_calibration(stats: DataFrame, root: str, model: str, dimensions: int, bits: int | None) -> bool:
    """Keep what ``retrieval.calibration`` found as the current version of ``root``, if it found a threshold; else what is there
    stays.  Whether it was kept."""
    row = stats.select("same_pairs", "conflict_pairs", "max_same", "min_conflict", "threshold").first()
    if row is None or row["threshold"] is None:
        return False
    made = stats.sparkSession.createDataFrame([(datetime.now(UTC).isoformat(), model, dimensions, bits, *row)], CALIBRATION)
    publish({"calibration": made}, root)
    return True


def load_calibration(spark: SparkSession, root: str, model: str, dimensions: int, bits: int | None) -> float | None:
    """The threshold that was kept for this model, number of dimensions and hash gate; None if it is for others or missing."""
    path = current(spark, root, "calibration")
    row = spark.read.schema(CALIBRATION).parquet(path).first() if path else None
    same = row is not None and (row["embedding_model"], row["embedding_dimensions"], row["bits"]) == (model, dimensions, bits)
    return row["threshold"] if same else None


def append(df: DataFrame, path: str, kind: str = "json") -> None:
    df.write.mode("append").format(kind).save(path)


def write_report(report: DataFrame, path: str) -> None:
    """One CSV file with a header, in the order of the report."""
    report.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_new_records(records: DataFrame, new: DataFrame, path: str) -> DataFrame:
    """Append records whose id is not held yet; held ones are never changed."""
    fresh = new.dropDuplicates(["record_id"]).join(records.select("record_id"), "record_id", "left_anti")
    fresh.write.mode("append").json(path)
    return fresh


def run_name(video: str, camera: str | None, now: datetime | None = None) -> str:
    stem = re.sub(r"\.[^.]*$", "", video.rsplit("/", 1)[-1])
    stamp = (now or datetime.now(UTC)).strftime("%Y%m%d-%H%M%SZ")
    return f"{stem}--camera-{camera}--{stamp}" if camera else f"{stem}--{stamp}"


def allocate_run(spark: SparkSession, root: str, video: str, camera: str | None, now: datetime | None = None) -> str:
    """Make a new folder for a run; of equal names the later ones get a number."""
    name = run_name(video, camera, now)
    for i in range(1, 100):
        path = f"{root}/{name}" + (f"--{i:02d}" if i > 1 else "")
        fs, at = _fs(spark, path)
        if not fs.exists(at) and fs.mkdirs(at):
            return path
    raise OSError(f"no free name for {name}")


class RunTransaction:
    """Tables of a run, written to a staging folder and published together, or not at all."""

    def __init__(self, spark: SparkSession, root: str, manifest: dict, overwrite: bool = False):
        self.spark, self.root, self.manifest, self.overwrite = spark, root, manifest, overwrite
        self.staging = f"{root}.staging-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def write(self, name: str, df: DataFrame, kind: str = "json") -> None:
        df.write.format(kind).save(f"{self.staging}/{name}")
        self.tables.append(name)

    def publish(self, required: tuple[str, ...] = ()) -> None:
        if missing := [t for t in required if t not in self.tables]:
            self.discard()
            raise ValueError(f"not written: {', '.join(missing)}")
        if exists(self.spark, self.root):
            before = self.spark.read.json(f"{self.root}/run").first() if exists(self.spark, f"{self.root}/run") else None
            same = before is not None and all(before.asDict().get(k) == self.manifest.get(k) for k in ("video_path", "camera_id"))
            if not self.overwrite or not same:
                self.discard()
                raise ValueError(f"{self.root} exists" if not self.overwrite else f"{self.root} is not a run of this video and camera")
        self.spark.createDataFrame([self.manifest]).write.json(f"{self.staging}/run")
        fs, target = _fs(self.spark, self.root)
        old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.staging}.old")
        had = fs.exists(target)
        if had and not fs.rename(target, old):
            raise OSError(f"{self.root} could not be set aside")
        if not fs.rename(self.spark._jvm.org.apache.hadoop.fs.Path(self.staging), target):
            if had:
                fs.rename(old, target)
            raise OSError(f"{self.root} could not be published")
        if had:
            fs.delete(old, True)

    def discard(self) -> None:
        fs, at = _fs(self.spark, self.staging)
        fs.delete(at, True)
