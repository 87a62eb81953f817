"""Pictures: a polygon cut out of frames, and crops and composites as files in a folder that all executors mount."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velograph.functions.geometry import Polygon

IMAGE = "struct<height:int,width:int,nChannels:int,data:binary>"


def polygon_rect(polygon: Polygon) -> tuple[int, int, int, int]:
    """x, y, width and height of the pixels that a polygon of whole numbers reaches."""
    xs, ys = [int(p[0]) for p in polygon], [int(p[1]) for p in polygon]
    return min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1


def polygon_mask(polygon: Polygon, width: int, height: int) -> np.ndarray:
    """Which pixels of a picture are inside a polygon; those within half a pixel of its boundary are."""
    x, y = np.meshgrid(np.arange(width, dtype=float), np.arange(height, dtype=float))
    inside, near = np.zeros(x.shape, bool), np.zeros(x.shape, bool)
    for (ax, ay), (bx, by) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        dx, dy = float(bx - ax), float(by - ay)
        if dy:
            crosses = ((y < ay) != (y < by)) & (x < (y - ay) * (dx / dy) + ax)
            inside ^= crosses
        square = dx * dx + dy * dy
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / square, 0, 1) if square else 0.0
        near |= np.hypot(x - (ax + t * dx), y - (ay + t * dy)) <= 0.5
    return inside | near


def cut_to_polygon(frames: DataFrame, polygon: Polygon) -> DataFrame:
    """``frames`` with ``image`` cut to the polygon's rectangle, black outside the polygon, and ``offset`` of the cut.

    ``image`` is as Spark's image source gives it (height, width, nChannels, data by rows).  What lies beyond the picture is
    left out of the rectangle; a polygon all beyond it gives an empty picture, and a null image stays null.
    """
    left, top, w, h = polygon_rect(polygon)
    kept = [f for f in frames.schema if f.name not in ("image", "offset")]
    masks: dict[tuple[int, int], np.ndarray] = {}

    def cut(image):
        if image is None:
            return None
        height, width, depth = image["height"], image["width"], image["nChannels"]
        x, y = min(max(left, 0), width), min(max(top, 0), height)
        right, bottom = max(x, min(left + w, width)), max(y, min(top + h, height))
        pixels = np.frombuffer(image["data"], np.uint8).reshape(height, width, depth)[y:bottom, x:right]
        if (width, height) not in masks:
            moved = [(px - x, py - y) for px, py in polygon]
            masks[width, height] = polygon_mask(moved, right - x, bottom - y)
        data = np.where(masks[width, height][:, :, None], pixels, 0).astype(np.uint8).tobytes()
        return {"height": bottom - y, "width": right - x, "nChannels": depth, "data": data}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[[f.name for f in kept]].assign(image=pd.Series([cut(i) for i in batch["image"]], dtype=object, index=batch.index))

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"image {IMAGE}"])
    plain = F.when(F.col("image").isNotNull(), F.struct(*[F.col("image")[c].alias(c) for c in ("height", "width", "nChannels", "data")]))
    out = frames.select(*[f"`{f.name}`" for f in kept], plain.alias("image")).mapInPandas(run, schema)
    return out.withColumn("offset", F.struct(F.lit(max(left, 0)).alias("x"), F.lit(max(top, 0)).alias("y")))


def vehicle_pictures(crops: DataFrame) -> DataFrame:
    """(path, content) of crops (vehicle_index, source, content) of vehicles: the vehicle's number and the source's suffix."""
    suffix = F.regexp_extract("source", r"(\.[^./]+)$", 1)
    name = F.format_string("vehicle_%06d%s", "vehicle_index", F.when(suffix == "", ".jpg").otherwise(suffix))
    return crops.where("vehicle_index is not null").select(name.alias("path"), "content")


def grid_manifests(cells: DataFrame, grids: DataFrame) -> DataFrame:
    """(path, content) of composites and of what stands where in them: KEY.jpg, and KEY.json with request and cells.

    ``grids``: key, content, request (JSON text); ``cells``: key, index, source_image, cell_box, content_box.
    """
    image = F.concat("key", F.lit(".jpg"))
    inside = cells.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("index", "source_image", "cell_box", "content_box"))).alias("cells"))
    joined = grids.join(inside, "key", "left")
    told = F.concat(
        F.lit('{"image":"'), image, F.lit('","request":'), F.coalesce("request", F.lit("null")),
        F.lit(',"cells":'), F.coalesce(F.to_json("cells", {"ignoreNullFields": "false"}), F.lit("[]")), F.lit("}"),
    )
    notes = joined.select(F.concat("key", F.lit(".json")).alias("path"), told.cast("binary").alias("content"))
    return grids.select(image.alias("path"), "content").unionByName(notes)


def write_pictures(pictures: DataFrame, folder: str, replace: bool = True) -> None:
    """Write (path, content) into a folder that the driver and all executors mount.

    A file appears whole or not at all, so a task that runs again does no harm; ``replace`` false leaves files that are there.
    """

    def write(rows) -> None:
        for row in rows:
            target = os.path.join(folder, row["path"])
            if row["content"] is None or (not replace and os.path.exists(target)):
                continue
            os.makedirs(os.path.dirname(target), exist_ok=True)
            staged = f"{target}.{uuid.uuid4().hex}"
            with open(staged, "wb") as f:
                f.write(row["content"])
            os.replace(staged, target)

    pictures.select("path", "content").foreachPartition(write)
