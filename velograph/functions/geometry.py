"""Points, polygons and the plane of the road.  Polygons and transforms are literals; points are Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from velograph.functions import boxes

Polygon = Sequence[tuple[float, float]]


def _edges(polygon: Polygon) -> list[tuple[tuple[float, float], tuple[float, float]]]:
    return list(zip(polygon, [*polygon[1:], polygon[0]], strict=True))


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _on_segment(x: Column, y: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    (ax, ay), (bx, by) = a, b
    level = (x - ax) * float(by - ay) - (y - ay) * float(bx - ax) == 0
    return level & x.between(float(min(ax, bx)), float(max(ax, bx))) & y.between(float(min(ay, by)), float(max(ay, by)))


def in_polygon(x: Column, y: Column, polygon: Polygon) -> Column:
    """Inside or on the boundary, by the number of edges that a ray to the right crosses."""
    crossings, touching = F.lit(0), []
    for (ax, ay), (bx, by) in _edges(polygon):
        touching.append(_on_segment(x, y, (ax, ay), (bx, by)))
        if ay != by:
            at = (y - float(ay)) * (float(bx - ax) / float(by - ay)) + float(ax)
            crossings = crossings + F.when(((y < float(ay)) != (y < float(by))) & (x < at), 1).otherwise(0)
    return _any(touching) | (crossings % 2 == 1)


def distance_to_polygon(x: Column, y: Column, polygon: Polygon) -> Column:
    """Distance to the boundary, negative outside."""
    lengths = []
    for (ax, ay), (bx, by) in _edges(polygon):
        dx, dy = float(bx - ax), float(by - ay)
        square = dx * dx + dy * dy
        t = F.least(F.greatest(((x - ax) * dx + (y - ay) * dy) / square, F.lit(0.0)), F.lit(1.0)) if square else F.lit(0.0)
        lengths.append(F.hypot(x - (t * dx + float(ax)), y - (t * dy + float(ay))))
    near = reduce(lambda a, b: F.least(a, b), lengths)
    return F.when(in_polygon(x, y, polygon), near).otherwise(-near)


def segment_meets_box(x1: Column, y1: Column, x2: Column, y2: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Whether the segment from a to b has a point in the box: the stretches of it between the box's sides overlap."""
    begins, ends, fixed = [F.lit(0.0)], [F.lit(1.0)], []
    for low, high, p, q in ((x1, x2, a[0], b[0]), (y1, y2, a[1], b[1])):
        step = float(q - p)
        if step == 0:
            fixed.append(F.lit(float(p)).between(low, high))
        else:
            first, last = (low - float(p)) / step, (high - float(p)) / step
            begins.append(first if step > 0 else last)
            ends.append(last if step > 0 else first)
    overlap = (F.greatest(*begins) <= F.least(*ends)) if len(begins) > 1 else F.lit(True)
    return reduce(lambda c, d: c & d, fixed, overlap)


def touches_polygon_edge(b: Column, polygon: Polygon, margin: int = 0) -> Column:
    """Whether a box comes within ``margin`` of a polygon's boundary: a vertex lies in the box widened by the margin to
    whole pixels, an edge meets that box, or a corner of the box itself is outside or nearer than the margin.  Always
    true for boxes without a size, never for fewer than two points."""
    if len(polygon) < 2:
        return F.lit(False)
    m = float(max(0, margin))
    x1, y1, x2, y2 = F.floor(b["x1"]) - m, F.floor(b["y1"]) - m, F.ceil(b["x2"]) + m, F.ceil(b["y2"]) + m
    tests = [segment_meets_box(x1, y1, x2, y2, a, c) for a, c in _edges(polygon)]  # a vertex in the box is on one
    if len(polygon) > 2:
        own = [(b["x1"], b["y1"]), (b["x2"], b["y1"]), (b["x2"], b["y2"]), (b["x1"], b["y2"])]
        tests += [distance_to_polygon(x, y, polygon) <= m if m else distance_to_polygon(x, y, polygon) < 0 for x, y in own]
    bad = (b["x2"] <= b["x1"]) | (b["y2"] <= b["y1"]) | b["x1"].isNull()
    return F.when(bad, True).otherwise(_any(tests))


def fit_homography(source: Sequence[tuple[float, float]], target: Sequence[tuple[float, float]]) -> np.ndarray:
    """The 3 x 3 projective transform of at least four pairs of points, by normalised least squares.

    Raises ValueError for too few or degenerate points, and where a point lands too far from its target: 0.001 times
    the largest target coordinate for four pairs, 0.2 or 1 % of it for more.
    """
    s, t = np.asarray(source, float), np.asarray(target, float)
    if s.shape != t.shape or s.ndim != 2 or len(s) < 4:
        raise ValueError("a homography takes at least four pairs of points")

    def normal(p: np.ndarray) -> np.ndarray:
        mean = p.mean(axis=0)
        spread = np.sqrt(((p - mean) ** 2).sum(axis=1)).mean()
        scale = np.sqrt(2) / spread if spread else 1.0
        return np.array([[scale, 0, -scale * mean[0]], [0, scale, -scale * mean[1]], [0, 0, 1]])

    def put(h: np.ndarray, p: np.ndarray) -> np.ndarray:
        q = np.c_[p, np.ones(len(p))] @ h.T
        return q[:, :2] / q[:, 2:]

    ns, nt = normal(s), normal(t)
    rows = []
    for (x, y), (u, v) in zip(put(ns, s), put(nt, t), strict=True):
        rows += [[-x, -y, -1, 0, 0, 0, u * x, u * y, u], [0, 0, 0, -x, -y, -1, v * x, v * y, v]]
    _, sizes, vt = np.linalg.svd(np.array(rows))
    h = np.linalg.inv(nt) @ vt[-1].reshape(3, 3) @ ns
    if not np.isfinite(h).all() or abs(h[2, 2]) < 1e-12 or sizes[7] < 1e-10 * sizes[0]:
        raise ValueError("the points do not fix a homography")
    h = h / h[2, 2]
    largest = max(1.0, float(np.abs(t).max()))
    off = np.sqrt(((put(h, s) - t) ** 2).sum(axis=1)).max()
    if not np.isfinite(off) or off > (1e-3 * largest if len(s) == 4 else max(0.20, 0.01 * float(np.abs(t).max()))):
        raise ValueError(f"the points are {off:.3g} off after the transform")
    return h


def to_world(x: Column, y: Column, h: np.ndarray) -> Column:
    """STRUCT<x, y> of a point on the road; infinite where the point has no image."""
    row = [[float(v) for v in r] for r in np.asarray(h)]
    u, v, w = (x * a + y * b + c for a, b, c in row)
    ok = (w != 0) & ~F.isnan(w)
    inf = F.lit(float("inf"))
    return F.struct(F.when(ok, u / w).otherwise(inf).alias("x"), F.when(ok, v / w).otherwise(inf).alias("y"))


def world_distance(p: Column, q: Column) -> Column:
    """Distance of two world points; infinite if a coordinate is not finite."""
    parts = [p["x"], p["y"], q["x"], q["y"]]
    bad = _any([v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) for v in parts])
    return F.when(bad, float("inf")).otherwise(F.hypot(p["x"] - q["x"], p["y"] - q["y"]))


def side_of_line(x: Column, y: Column, start: tuple[float, float], end: tuple[float, float]) -> Column:
    """1 left of the way from start to end, -1 right of it, 0 on it; null beyond the ends of the segment."""
    (ax, ay), (bx, by) = start, end
    dx, dy = float(bx - ax), float(by - ay)
    along = (x - ax) * dx + (y - ay) * dy
    return F.when(along.between(0.0, dx * dx + dy * dy), F.signum((y - ay) * dx - (x - ax) * dy).cast("int"))


def bounding_box(polygon: Polygon) -> tuple[float, float, float, float]:
    xs, ys = zip(*polygon, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def offset(b: Column, polygon: Polygon) -> Column:
    """A box found in the polygon's bounding rectangle, in coordinates of the frame."""
    x, y, *_ = bounding_box(polygon)
    return boxes.shifted(b, x, y)
