"""Scans: sampled frames, JSON lines and documents, CSV dimensions, records, and slots for what reads pixels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

POWERTRAINS = ("BEV", "COMBUSTION", "MIXED", "UNKNOWN")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def sampled_frames(spark: SparkSession, frames: int, source_fps: float, target_fps: float, terminal: bool = False) -> DataFrame:
    """(frame_index, t) of the frames that sampling at ``target_fps`` takes, and the last one if ``terminal``.

    Frame i is taken if the clock of taken frames, which goes on by one period for each, has come to it; as a period is
    no shorter than a frame, that is where the number of periods up to i goes up.
    """
    if source_fps <= 0 or target_fps <= 0:
        raise ValueError("frame rates are positive")
    period = 1.0 / min(target_fps, source_fps)
    periods = lambda i: F.floor((i / F.lit(float(source_fps)) + 1e-9) / period)
    i = F.col("id")
    taken = (i == 0) | (periods(i) > periods(i - 1))
    if terminal:
        taken = taken | (i == frames - 1)
    return spark.range(frames).where(taken).select(i.alias("frame_index"), (i / F.lit(float(source_fps))).alias("t"))


def sampled_frames_of(videos: DataFrame, terminal: bool = False) -> DataFrame:
    """(run_id, frame_index, t) of the frames that sampling takes of each of ``videos`` (run_id, frames, source_fps, target_fps).

    As ``sampled_frames``; a row's frames are made where the row is, and rates that are not positive are an error.
    """
    rates = F.least("source_fps", "target_fps")
    checked = F.when(rates > 0, F.col("frames")).otherwise(F.raise_error(F.lit("frame rates are positive")))
    every = videos.where("frames > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), checked.cast("long") - 1)).alias("i"))
    periods = lambda i: F.floor((i / F.col("source_fps") + 1e-9) / (F.lit(1.0) / rates))
    i = F.col("i")
    taken = (i == 0) | (periods(i) > periods(i - 1)) | (F.lit(terminal) & (i == F.col("frames") - 1))
    return every.where(taken).select("run_id", i.alias("frame_index"), (i / F.col("source_fps")).alias("t"))


def check_fps(found: float, expected: float | None, tolerance: float) -> None:
    if found <= 0 or (expected is not None and abs(found - expected) > tolerance):
        raise ValueError(f"the video has {found} frames a second, not {expected}")


def read_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines of a fixed schema; a missing file is an empty table, a broken line an error."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_keyed_document(spark: SparkSession, path: str, value: str, key: str = "track_id") -> DataFrame:
    """A JSON object keyed by id as rows: the id as ``key``, then the fields of ``value`` (a struct type)."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"{key} long, label {value}").select(key, "label.*")
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", f"map<string, {value}>", {"mode": "FAILFAST"})).alias(key, "label"))
    return rows.select(F.col(key).cast("long").alias(key), "label.*")


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON records; unreadable ones are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


def effective(spark: SparkSession, linked: str, raw: str) -> str:
    """The linked table's path if there is one, else the raw one's."""
    return linked if exists(spark, linked) else raw


def read_countries(spark: SparkSession, path: str) -> DataFrame:
    """(make, flag); of a make named twice the last row stays."""
    return _last_by(_csv(spark, path, ["make", "flag"]), ["make"])


def read_powertrains(spark: SparkSession, path: str) -> DataFrame:
    """(make, model, generation, variation, powertrain); an unknown powertrain is an error, the last of equals stays."""
    rows = _csv(spark, path, ["make", "model", "generation", "variation", "powertrain"])
    checked = F.when(F.col("powertrain").isin(*POWERTRAINS), F.col("powertrain")).otherwise(F.raise_error(F.concat(F.lit("unknown powertrain "), F.coalesce("powertrain", F.lit("null")))))
    rows = rows.withColumns({"powertrain": checked, "variation": F.coalesce("variation", F.lit(""))})
    return _last_by(rows, ["make", "model", "generation", "variation"])


def _csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    rows = spark.read.csv(path, header=True, mode="FAILFAST")
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"{path} has no column {', '.join(missing)}")
    return rows.select(*columns, F.monotonically_increasing_id().alias("_line"))


def _last_by(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("_line"))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_line")


def detections_from(frames: DataFrame, model: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A slot for a detector, an embedder or a service: ``model`` takes and gives batches; the default is a replay of
    stored detections with ``read_lines``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield model(batch)

    return frames.mapInPandas(run, schema)


def observations_of(frames: DataFrame, column: str = "tracks") -> DataFrame:
    """Flat rows of nested frame records, with ``pos`` in the frame."""
    return frames.select(*[c for c in frames.columns if c != column], F.posexplode(column).alias("pos", "_o")).select("*", "_o.*").drop("_o")


def image_folder(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.format("binaryFile").load(path).select("path", "content")
    except AnalysisException:
        return spark.createDataFrame([], "path string, content binary")


def with_current_keys(summaries: DataFrame) -> DataFrame:
    """Track summaries of older runs, in which the keys of heights held widths: where a record has no width, its height is
    the width and the height is unknown.  Newer records stay as they are."""
    out = summaries
    for end in ("min", "max"):
        old, new = f"{end}_box_height_px", f"{end}_box_width_px"
        if old in out.columns:
            known = F.col(new) if new in out.columns else F.lit(None).cast(out.schema[old].dataType)
            out = out.withColumns({new: F.coalesce(known, F.col(old)), old: F.when(known.isNotNull(), F.col(old))})
    return out
