"""Boxes as struct columns: STRUCT<x1, y1, x2, y2: DOUBLE>.  All functions take and give Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*[_col(v).cast("double").alias(n) for n, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2))])


def width(b: Column) -> Column:
    return F.greatest(b["x2"] - b["x1"], F.lit(0.0))


def height(b: Column) -> Column:
    return F.greatest(b["y2"] - b["y1"], F.lit(0.0))


def area(b: Column) -> Column:
    return width(b) * height(b)


def center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), ((b["y1"] + b["y2"]) / 2).alias("y"))


def bottom_center(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("x"), b["y2"].alias("y"))


def intersection_area(a: Column, b: Column) -> Column:
    across = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    down = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(across, F.lit(0.0)) * F.greatest(down, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where the union has no area."""
    shared = intersection_area(a, b)
    union = area(a) + area(b) - shared
    return F.when(union > 0, shared / union).otherwise(0.0)


def smaller_coverage(a: Column, b: Column) -> Column:
    """The part of the smaller box that the two share; 0 where it has no area."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection_area(a, b) / least).otherwise(0.0)


def _ratio(a: Column, b: Column) -> Column:
    most = F.greatest(a, b)
    return F.when(most > 0, F.least(a, b) / most).otherwise(0.0)


def area_ratio(a: Column, b: Column) -> Column:
    return _ratio(area(a), area(b))


def size_ratios(a: Column, b: Column) -> tuple[Column, Column]:
    """Smaller over larger, of the widths and of the heights."""
    return _ratio(width(a), width(b)), _ratio(height(a), height(b))


def center_distance(a: Column, b: Column) -> Column:
    p, q = center(a), center(b)
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def center_error(predicted: Column, seen: Column) -> Column:
    """Distance of the centers in units of the larger dimension of both boxes; infinite where that is 0."""
    scale = F.greatest(width(predicted), height(predicted), width(seen), height(seen))
    return F.when(scale > 0, center_distance(predicted, seen) / scale).otherwise(float("inf"))


def contains(b: Column, x: Column, y: Column, half_open: bool = False) -> Column:
    right = (x < b["x2"]) & (y < b["y2"]) if half_open else (x <= b["x2"]) & (y <= b["y2"])
    return (x >= b["x1"]) & (y >= b["y1"]) & right


def shifted(b: Column, dx, dy) -> Column:
    """From coordinates of a part of the image to those of the whole."""
    dx, dy = _col(dx), _col(dy)
    return box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def clipped(b: Column, frame_width, frame_height) -> Column:
    """Corners moved into [0, width - 1] x [0, height - 1]; null where nothing is left."""
    right, bottom = _col(frame_width) - 1, _col(frame_height) - 1
    into = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most)
    out = box(into(b["x1"], right), into(b["y1"], bottom), into(b["x2"], right), into(b["y2"], bottom))
    return F.when((out["x2"] > out["x1"]) & (out["y2"] > out["y1"]), out)


def padded(b: Column, frame_width, frame_height, share: float = 0.05, extra: float = 2.0) -> Column:
    """The box with a margin on each side, cut to whole pixels of the frame; the box itself where nothing is left."""
    px, py = width(b) * share + extra, height(b) * share + extra
    whole = lambda v: v.cast("int").cast("double")  # noqa: E731  towards zero
    into = lambda v, most: F.least(F.greatest(whole(v), F.lit(0.0)), _col(most))
    out = box(into(b["x1"] - px, frame_width), into(b["y1"] - py, frame_height), into(b["x2"] + px, frame_width), into(b["y2"] + py, frame_height))
    return F.when((out["x2"] > out["x1"]) & (out["y2"] > out["y1"]), out).otherwise(b)


def from_center(x: Column, y: Column, w: Column, h: Column, least: float = 0.0) -> Column:
    w, h = F.greatest(w, F.lit(least)), F.greatest(h, F.lit(least))
    return box(x - w / 2, y - h / 2, x + w / 2, y + h / 2)


def touches_frame_edge(b: Column, left, top, right, bottom, margin: int = 0) -> Column:
    """Whether whole pixels of the box come within ``margin`` of a rectangle's edge; true for boxes without a size."""
    m = F.lit(max(0, margin))
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    bad = odd(b["x1"]) | odd(b["y1"]) | odd(b["x2"]) | odd(b["y2"]) | (b["x2"] <= b["x1"]) | (b["y2"] <= b["y1"])
    near = (F.floor(b["x1"]) <= _col(left) + m) | (F.floor(b["y1"]) <= _col(top) + m) | (F.ceil(b["x2"]) >= _col(right) - 1 - m) | (F.ceil(b["y2"]) >= _col(bottom) - 1 - m)
    return F.when(bad, True).otherwise(near)


def fitted_into(source_width: Column, source_height: Column, cell: Column) -> Column:
    """The box that an image takes in a cell of a composite: as large as its proportions allow, centered, whole pixels
    (halves go to the even number)."""
    scale = F.least(width(cell) / source_width, height(cell) / source_height)
    w, h = F.greatest(F.bround(source_width * scale), F.lit(1.0)), F.greatest(F.bround(source_height * scale), F.lit(1.0))
    x, y = cell["x1"] + F.floor((width(cell) - w) / 2), cell["y1"] + F.floor((height(cell) - h) / 2)
    return box(x, y, x + w, y + h)


def out_of_cell(found: Column, placed: Column, source_width: Column, source_height: Column) -> Column:
    """A box found in a composite, in pixels of the image that was placed there; null if nothing of it is on it."""
    x = lambda v: F.least(F.greatest((v - placed["x1"]) * source_width / width(placed), F.lit(0.0)), source_width)
    y = lambda v: F.least(F.greatest((v - placed["y1"]) * source_height / height(placed), F.lit(0.0)), source_height)
    out = box(x(found["x1"]), y(found["y1"]), x(found["x2"]), y(found["y2"]))
    return F.when((out["x2"] > out["x1"]) & (out["y2"] > out["y1"]), out)
