"""Operator 12 against plain rounds over all vectors, and its trees against all distances."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from velograph.llm.op12_balltree import DOUBLES, Tree, assigned, clustered, distances, part_of

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows, k, rounds, dim, seed="2"):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = {c: sum(d for _, x, d in found if x == c) for _, c, _ in found}
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found), key=str)


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(9, dim))
    points = middle[rng.integers(9, size=n)] + rng.normal(size=(n, dim)) * rng.choice([0.001, 0.1, 0.6], size=(n, 1))
    rows = [(i, p.tolist(), i % 3) for i, p in enumerate(points)]
    rows += [(n + i, rows[5][1], None) for i in range(60)] + [(3, rows[5][1], 1), (3, rows[8][1], 1), (None, rows[2][1], 1), (None, [0.0] * dim, 2)]
    rows += [(n + 100, None, 1), (n + 101, [1.0] * (dim - 1), 1), (n + 102, [float("nan")] * dim, 1), (n + 103, [float("inf"), *[0.0] * (dim - 1)], 1), (n + 104, [None, *[0.0] * (dim - 1)], 1), (n + 105, [], 1)]
    return rows


@pytest.mark.parametrize(("k", "tree_rows"), [(7, 4_096), (7, 50), (40, 300), (1, 64)])
def test_equal_to_plain_rounds(spark, k, tree_rows):
    rows = vectors(400, 6, k)
    got = clustered(spark.createDataFrame(rows, SCHEMA).repartition(3), k, rounds=3, dim=6, tree_rows=tree_rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, k, 3, 6)


def test_few_vectors_ties_and_empty(spark):
    rows = [(i, [float(i % 2), 0.0], 1) for i in range(6)]
    got = clustered(spark.createDataFrame(rows, SCHEMA), 40, dim=2)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, 40, 5, 2)
    none = clustered(spark.createDataFrame([(1, None, 1)], SCHEMA), 4, dim=2)
    assert none.collect() == [] and none.columns == got.columns
    assert clustered(spark.createDataFrame([], SCHEMA), 4, dim=2).collect() == []


def test_extra_columns_and_too_large(spark):
    rows = vectors(60, 4, 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("cluster", "distance", "vector", "n", "sums", "ids", "points"):
        docs = docs.withColumn(name, F.lit("x"))
    assert sorted((tuple(r) for r in clustered(docs, 5, dim=4).collect()), key=str) == plain(rows, 5, 5, 4)
    with pytest.raises(Exception, match="may not fit a long"):
        clustered(spark.createDataFrame([(1, [1e9, 0.0], 1), (2, [0.0, 0.0], 1)], SCHEMA), 1, dim=2).collect()


def test_trees_give_whole_balls_and_exact_sums():
    rng = np.random.default_rng(5)
    points = np.concatenate([rng.integers(-200, 200, size=(1, 8)) * 100 + rng.integers(-3, 4, size=(500, 8)) for _ in range(6)] + [np.full((300, 8), 7)])
    order, tree = Tree.grow(points)
    assert sorted(order.tolist()) == list(range(len(points))) and (tree.points == points[order]).all()
    centroids = points[rng.choice(len(points), 12, replace=False)]
    balls, rest = tree.split(centroids)
    assert sum(tree.count[b] for b, _ in balls) + len(rest) == len(points) and sum(tree.count[b] for b, _ in balls) > 300
    all_ = np.stack([np.square(tree.points - c).sum(axis=1) for c in centroids], axis=1)
    nearest, away = assigned(tree, centroids)
    assert (nearest == all_.argmin(axis=1)).all() and (away == all_.min(axis=1)).all()
    counts, sums = np.zeros(12, np.int64), np.zeros((12, 8), np.int64)
    part_of(tree, centroids, counts, sums)
    assert (counts == np.bincount(nearest, minlength=12)).all()
    assert all((sums[c] == tree.points[nearest == c].sum(axis=0)).all() for c in range(12))
    again = Tree.of_row(tree.to_row(), 8)
    assert again.split(centroids)[0] == balls


def test_distances_beyond_whole_doubles():
    rng = np.random.default_rng(6)
    points, centroids = rng.integers(-(1 << 27), 1 << 27, size=(20, 64)), rng.integers(-(1 << 27), 1 << 27, size=(3, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in centroids] for p in points]
    assert distances(points, centroids).tolist() == want
    small = points % (2 * DOUBLES) - DOUBLES
    assert distances(small, small[:3]).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, c)) for c in small[:3]] for p in small]
