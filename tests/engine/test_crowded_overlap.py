"""Overlaps in a crowded frame."""

from __future__ import annotations

import numpy as np

from velograph.operators import aggregates


def test_covered_is_the_sum_of_all_overlaps(monkeypatch):
    rng = np.random.default_rng(2)
    low = rng.uniform(0, 900, (600, 2))
    b = np.hstack([low, low + rng.uniform(0, 40, (600, 2))])
    pos = np.arange(600)
    monkeypatch.setattr(aggregates, "STRIP", 50)
    monkeypatch.setattr(aggregates, "MEETING", 16)
    size = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    shared = np.clip(np.minimum(b[:, None, 2:], b[None, :, 2:]) - np.maximum(b[:, None, :2], b[None, :, :2]), 0, None).prod(axis=2)
    np.fill_diagonal(shared, 0)
    want = np.minimum(1, shared.sum(axis=1) / size)
    assert (want == 1).any() and ((want > 0) & (want < 1)).any() and np.allclose(np.minimum(1, aggregates._covered(pos, b)), want)


def test_boxes_of_a_frame_are_not_joined_with_each_other(spark):
    rows = spark.sql("select 'r' run_id, 1L frame_index, id pos, struct(0D x1, 0D y1, 10D x2, 10D y2) bbox from range(3)")
    out = aggregates.sibling_overlap(rows)
    assert [r.overlap for r in out.collect()] == [1.0] * 3
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
