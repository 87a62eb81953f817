from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from velograph.functions import boxes, geometry, text, vectors
from velograph.plans import config


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lit_box(*v):
    return boxes.box(*[F.lit(float(x)) for x in v])


def test_boxes(spark):
    a, b, flat = lit_box(0, 0, 10, 10), lit_box(5, 5, 15, 25), lit_box(3, 3, 1, 9)
    r = one(spark, iou=boxes.iou(a, b), none=boxes.iou(flat, flat), cover=boxes.smaller_coverage(a, b), ratio=boxes.area_ratio(a, b), far=boxes.center_distance(a, b), w=boxes.width(flat), err=boxes.center_error(flat, lit_box(1, 1, 1, 1)), sizes=F.array(*boxes.size_ratios(a, b)), foot=boxes.bottom_center(b))
    assert r.iou == 25 / 275 and r.none == 0 and r.cover == 0.25 and r.ratio == 0.5 and r.far == pytest.approx(math.hypot(5, 10)) and r.w == 0
    assert r.err > 0 and r.sizes == [1.0, 0.5] and (r.foot.x, r.foot.y) == (10, 25)
    p = one(spark, pad=boxes.padded(lit_box(10, 10, 110, 60), 115, 200), clip=boxes.clipped(lit_box(-5, -5, 500, 20), 100, 50), gone=boxes.clipped(lit_box(200, 0, 300, 10), 100, 50), keep=boxes.padded(lit_box(500, 0, 600, 10), 100, 50))
    assert tuple(p.pad) == (3, 5, 115, 64) and tuple(p.clip) == (0, 0, 99, 20) and p.gone is None and tuple(p.keep) == (500, 0, 600, 10)


def test_edges_of_frames_and_polygons(spark):
    square = [(10, 10), (90, 10), (90, 90), (10, 90)]
    at = lambda *v, m=0: boxes.touches_frame_edge(lit_box(*v), 0, 0, 100, 100, m)
    near = lambda *v, m=0: geometry.touches_polygon_edge(lit_box(*v), square, m)
    r = one(spark, a=at(1, 1, 50, 50), b=at(0.5, 5, 50, 50), c=at(5, 5, 98.5, 50), d=at(5, 5, 50, 50, m=5), e=at(9, 9, 5, 20), p=near(20, 20, 40, 40), q=near(5, 20, 15, 40), s=near(20, 20, 40, 40, m=12), t=near(1, 1, 3, 3), u=geometry.touches_polygon_edge(lit_box(1, 1, 3, 3), [(0, 0)]))
    assert (r.a, r.b, r.c, r.d, r.e) == (False, True, True, True, True)
    assert (r.p, r.q, r.s, r.t, r.u) == (False, True, True, True, False)


def test_polygons_hold_their_boundary(spark):
    shape = [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)]
    points = [(5.0, 2.0, True), (5.0, 5.0, True), (5.0, 8.0, False), (0.0, 4.0, True), (10.0, 10.0, True), (11.0, 5.0, False), (2.0, 8.0, True), (-1.0, 0.0, False), (5.0, 0.0, True)]
    rows = spark.createDataFrame(points, "x double, y double, want boolean").withColumn("got", geometry.in_polygon(F.col("x"), F.col("y"), shape)).collect()
    assert all(r.got == r.want for r in rows)
    d = one(spark, a=geometry.distance_to_polygon(F.lit(5.0), F.lit(2.0), shape), b=geometry.distance_to_polygon(F.lit(13.0), F.lit(0.0), shape))
    assert d.a == 2.0 and d.b == -3.0


def test_homography(spark):
    h = geometry.fit_homography([(0, 0), (400, 0), (400, 300), (0, 300)], [(0, 0), (40, 0), (40, 30), (0, 30)])
    at = lambda x, y: geometry.to_world(F.lit(float(x)), F.lit(float(y)), h)
    r = one(spark, p=at(200, 150), d=geometry.world_distance(at(100, 100), at(300, 100)), bad=geometry.world_distance(at(1, 1), geometry.to_world(F.lit(1.0), F.lit(0.0), np.array([[1, 0, 0], [0, 1, 0], [1, 0, -1]]))))
    assert (r.p.x, r.p.y) == (pytest.approx(20), pytest.approx(15)) and r.d == pytest.approx(20) and r.bad == math.inf
    with pytest.raises(ValueError):
        geometry.fit_homography([(0, 0), (1, 0), (2, 0), (3, 0)], [(0, 0), (1, 0), (2, 0), (3, 0)])
    with pytest.raises(ValueError):
        geometry.fit_homography([(0, 0), (1, 0), (1, 1)], [(0, 0), (1, 0), (1, 1)])


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    d = vectors.cosine_distance
    r = one(spark, a=d(v(1, 0), v(1, 0)), b=d(v(1, 0), v(0, 1)), c=d(v(0, 0), v(0, 0)), e=d(v(0, 0), v(1, 0)), f=d(v(1), v(1, 0)), h=vectors.hamming(F.lit(-1), F.lit(0)), ok=vectors.is_embedding(v(1, 2), 2), bad=vectors.is_embedding(v(1, float("nan")), 2))
    assert (r.a, r.b, r.c, r.e, r.f) == (0.0, 1.0, 0.0, math.inf, math.inf) and r.ok and not r.bad
    image = np.random.default_rng(1).integers(0, 200, (64, 96)).astype(float)
    assert vectors.perceptual_hash(image) == vectors.perceptual_hash(image + 5) != vectors.perceptual_hash(image[::-1])
    assert vectors.sharpness(np.full((8, 8), 3.0)) == 0 < vectors.sharpness(np.indices((8, 8)).sum(0) % 2 * 9.0)


def test_texts(spark):
    s = F.lit
    r = one(
        spark, a=text.normal_identity(s(" \t Straße\n")), n=text.normal_identity(s(None).cast("string")), t=text.tag_column(s("Police  Car!")), e=text.tag_column(s("--")), y=text.is_affirmative(s("YES")), o=text.is_affirmative(s("1.0")), f=text.is_affirmative(s("no")),
        label=text.coerced_label(s(None).cast("string"), s(" light_truck ")), score=text.coerced_confidence(s(None).cast("string"), s("0"), s("0.7")), bgr=text.hex_to_bgr(s("#47C8FF")), flags=text.split_flags(s("\U0001f1e9\U0001f1ea ok \U0001f1eb\U0001f1f7")),
        show=text.display_label(s("F"), s("Make"), s("OLD"), s(""), s("old"), s(" OLD ")), full=text.display_label(s(None).cast("string"), s("Make"), s("M1"), s(None).cast("string"), s("II"), s("")),
    )
    assert (r.a, r.n, r.t, r.e) == ("strasse", "", "tag_police_car", "") and (r.y, r.o, r.f) == (True, True, False)
    assert (r.label, r.score, r.bgr) == ("light truck", 0.7, [255, 200, 71]) and r.flags == ["\U0001f1e9\U0001f1ea", " ok ", "\U0001f1eb\U0001f1f7"]
    assert (r.show, r.full) == ("F Make", "Make M1\nII")


def test_configuration():
    assert config.merged({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}}, {"a": {"d": 3}, "e": 4}) == {"a": {"b": 1, "c": [2], "d": 3}, "e": 4}
    with pytest.raises(ValueError):
        config.check({"detector": {"confidence": 0.7}, "tracker": {"high_conf_det_threshold": 0.6}})
    assert config.clean_camera_id("A1.mp4") == "A1"
    for bad in ("", "..", "a/b", "a\\b"):
        with pytest.raises(ValueError):
            config.clean_camera_id(bad)
    camera = config.Camera.of({"camera_id": "x", "polygon": [[0, 0], [1, 0], [1, 1]], "count_line": {"start": [0, 0], "end": [1, 1]}, "homography": {"source_points": [[0, 0], [4, 0], [4, 3], [0, 3]], "target_points": [[0, 0], [8, 0], [8, 6], [0, 6]]}})
    assert camera.direction == "BOTH" and camera.homography[0, 0] == pytest.approx(2)
