"""Operator 13 against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from velograph.llm.op13_quantisation import Quantiser, near_duplicates, unit

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, threshold=0.98):
    """All pairs; (vec_id, links, component, kept) sorted."""
    fit = [label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, label in rows]
    near = [set() for _ in rows]
    for i, (_, a, la) in enumerate(rows):
        for j in range(i):
            b, lb = rows[j][1:]
            if fit[i] and fit[j] and la == lb and len(a) == len(b):
                x, y = np.array(a) / max(map(abs, a)), np.array(b) / max(map(abs, b))
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    near[i].add(j)
                    near[j].add(i)
    out, seen = [None] * len(rows), set()
    for i in range(len(rows)):
        if i in seen:
            continue
        stack, part = [i], {i}
        while stack:
            for j in near[stack.pop()] - part:
                part.add(j)
                stack.append(j)
        seen |= part
        least = min((rows[j][0] for j in part if rows[j][0] is not None), default=None)
        for j in part:
            out[j] = (rows[j][0], len(near[j]), least, rows[j][0] == least)
    return sorted(out, key=str)


def vectors(seed, groups=14, size=12, dim=24):
    """Groups whose members are on both sides of the threshold, chains included, and vectors far from all."""
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(groups):
        middle = rng.normal(size=dim)
        for _ in range(size):
            rows.append((middle * rng.choice([1e-3, 1, 50]) + rng.normal(size=dim) * np.abs(middle).mean() * 0, int(g % 3)))
            rows[-1] = (middle + rng.normal(size=dim) * rng.choice([0.02, 0.1, 0.16]), int(g % 3))
    for g in range(4):
        at = rng.normal(size=dim)
        for _ in range(10):  # a chain
            at = at + rng.normal(size=dim) * 0.12
            rows.append((at, g % 3))
    rows += [(rng.normal(size=dim), int(rng.integers(3))) for _ in range(150)]
    out = [(i, (v * rng.choice([1e-3, 1.0, 50.0])).tolist(), label) for i, (v, label) in enumerate(rows)]
    n = len(out)
    out += [(n + i, out[3][1], out[3][2]) for i in range(40)] + [(n + 50, out[3][1], None), (n + 51, out[3][1], 99)]
    out += [(5, out[6][1], out[6][2]), (None, out[9][1], out[9][2]), (None, [1.0, 0.0], 1), (n + 52, [1.0, 0.01], 1), (n + 53, [], 1), (n + 54, None, 1)]
    out += [(n + 55, [0.0] * dim, 1), (n + 56, [float("nan")] * dim, 1), (n + 57, [1.0, None], 1), (n + 58, [1e300, 1e300], 2), (n + 59, [1e-320, 1e-320], 2), (n + 60, [float("-inf"), 1.0], 2)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"lists": 20}, {"lists": 6, "part_bytes": 2_000}])
def test_equal_to_all_pairs(spark, sizes):
    rows = vectors(4)
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), **sizes)
    want = plain(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(r[1] for r in want) > 1_000 and max(r[1] for r in want) > 40


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(empty).collect() == []
    unfit = spark.createDataFrame([(1, None, 1), (2, [0.0], 1), (3, [1.0], None)], SCHEMA)
    assert sorted(map(tuple, near_duplicates(unfit).collect())) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    rows = vectors(8, groups=3, size=4)
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("dim", "node", "rows", "list", "part", "vector", "n_links", "least", "takes", "c1"):
        docs = docs.withColumn(name, F.lit("x"))
    assert sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str) == plain(rows)


def test_bounds_hold_and_prune():
    """Probes and lookups pass every pair within reach, and far from all pairs."""
    rng = np.random.default_rng(2)
    u = unit(np.concatenate([rng.normal(size=(600, 32)), np.repeat(rng.normal(size=(20, 32)), 20, axis=0) + rng.normal(size=(400, 32)) * 0.03]))
    quantiser, reach = Quantiser(u[::2], 12), 0.2
    home, probes = quantiser.placed(u, reach)
    codes, error = quantiser.coded(u, home)
    passed = 0
    for list_ in range(len(quantiser.centroids)):
        inside = np.flatnonzero(home == list_)
        asks = np.flatnonzero([list_ in p for p in probes])
        sure = quantiser.lookups(u[asks], list_, codes[inside]) <= reach + error[inside] + 1e-6
        passed += sure.sum()
        near = np.sqrt(np.square(u[:, None] - u[inside]).sum(axis=2)) <= reach
        assert not near[np.setdiff1d(np.arange(len(u)), asks)].any()
        assert not (near[asks] & ~sure).any()
    assert passed < 0.1 * len(u) ** 2
