"""Centroid clustering on whole numbers, with ball trees that let whole balls of vectors go to one centroid.

Every partition packs its vectors into metric trees where they are, without a shuffle; a tree is one row of a table and
holds at most ``tree_rows`` vectors.  A node of a tree is a ball: its centre, radius, number of vectors and their whole
sum.  In each round a tree is walked level by level.  By the triangle inequality a centroid that is more than two radii
further from the centre than the nearest one is nearest to no vector of the ball.  Where one centroid is left, the ball's
count and sum are its part of that centroid; else the ball's children are looked at with the centroids that are left, and
the leaves exactly.  What leaves a partition is one row a centroid, and the centroids are a table of fixed size.

Centres and radii are floating point and are used with a margin far over their rounding; all that is kept is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm.tables import table
from velograph.plans.materialize import materialize

CENTROIDS, ROUNDS, DIM, SCALE = 40, 5, 64, 256
TREE_ROWS, LEAF = 4_096, 24
#: Whole components beyond this are refused: squared distances could leave 64 bits.
LARGEST = 1 << 27
#: Up to this, sums of 64 products are whole in a double.
DOUBLES = 1 << 22
MARGIN = 1e-9


def fit_for(vector: Column, dim: int = DIM) -> Column:
    """Whether a vector is clustered: ``dim`` components, none null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite, F.lit(False))


def whole(vectors: np.ndarray, scale: int = SCALE) -> np.ndarray:
    out = np.floor(vectors.astype(np.float64) * scale)
    if out.size and np.abs(out).max() > LARGEST:
        raise ValueError(f"components of {LARGEST // scale} and more have squared distances that may not fit a long")
    return out.astype(np.int64)


class Tree:
    """Points in tree order and the balls over them; children of a node follow it, leaves have none."""

    def __init__(self, points: np.ndarray, first: np.ndarray, count: np.ndarray, child: np.ndarray, radius: np.ndarray, sums: np.ndarray):
        self.points, self.first, self.count, self.child, self.radius, self.sums = points, first, count, child, radius, sums
        self.centre = sums / np.maximum(count, 1)[:, None]

    @staticmethod
    def grow(points: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, Tree]:
        """The order in which the tree keeps ``points``, and the tree."""
        order = np.arange(len(points))
        first, count, child, radius, sums = [0], [len(points)], [], [], []
        at = 0
        while at < len(first):
            b, n = first[at], count[at]
            own = points[order[b : b + n]]
            total = own.sum(axis=0)
            away = np.square(own - total / n).sum(axis=1)
            radius.append(float(np.sqrt(away.max())))
            sums.append(total)
            if n <= leaf or radius[-1] == 0:
                child.append((-1, -1))
            else:
                one = own[away.argmax()]
                two = own[np.square(own - one).sum(axis=1).argmax()]
                half = n // 2
                order[b : b + n] = order[b : b + n][np.argpartition(own @ (two - one), half)]
                child.append((len(first), len(first) + 1))
                first += [b, b + half]
                count += [half, n - half]
            at += 1
        return order, Tree(points[order], np.array(first), np.array(count), np.array(child), np.array(radius), np.array(sums))

    def to_row(self) -> dict:
        kept = {"points": self.points.astype("<i4"), "first": self.first.astype("<i4"), "count": self.count.astype("<i4"), "child": self.child.astype("<i4"), "radius": self.radius.astype("<f8"), "sums": self.sums.astype("<i8")}
        return {k: x.tobytes() for k, x in kept.items()}

    @staticmethod
    def of_row(row: pd.Series, dim: int) -> Tree:
        read = lambda k, kind: np.frombuffer(row[k], kind)
        return Tree(read("points", "<i4").astype(np.int64).reshape(-1, dim), read("first", "<i4"), read("count", "<i4"), read("child", "<i4").reshape(-1, 2), read("radius", "<f8"), read("sums", "<i8").reshape(-1, dim))

    def split(self, centroids: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
        """(ball, centroid) of balls that go whole, and the places of the points that have to be looked at exactly."""
        c = centroids.astype(np.float64)
        balls: list[tuple[int, int]] = []
        leaves: list[np.ndarray] = []
        nodes, left = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        while len(nodes):
            away = np.sqrt(np.stack([np.square(self.centre[nodes] - x).sum(axis=1) for x in c], axis=1))
            away[~left] = np.inf
            bound = away.min(axis=1) + 2 * self.radius[nodes]
            left = away <= (bound + MARGIN * (1 + bound))[:, None]
            alone = left.sum(axis=1) == 1
            balls += zip(nodes[alone].tolist(), left[alone].argmax(axis=1).tolist(), strict=True)
            open_, left = nodes[~alone], left[~alone]
            inner = self.child[open_, 0] >= 0
            leaves += [np.arange(self.first[x], self.first[x] + self.count[x]) for x in open_[~inner]]
            nodes, left = self.child[open_[inner]].ravel(), np.repeat(left[inner], 2, axis=0)
        return balls, np.concatenate([*leaves, np.empty(0, np.int64)])


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centroids, exactly."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= DOUBLES and points.shape[1] <= 64:
        p, c = points.astype(np.float64), centroids.astype(np.float64)
        return (np.square(p).sum(axis=1)[:, None] - 2 * (p @ c.T) + np.square(c).sum(axis=1)).astype(np.int64)
    return np.stack([np.square(points - c).sum(axis=1) for c in centroids], axis=1)


def part_of(tree: Tree, centroids: np.ndarray, counts: np.ndarray, sums: np.ndarray) -> None:
    """Add the tree's vectors to the counts and sums of their nearest centroids."""
    balls, rest = tree.split(centroids)
    for ball, c in balls:
        counts[c] += tree.count[ball]
        sums[c] += tree.sums[ball]
    if len(rest):
        nearest = distances(tree.points[rest], centroids).argmin(axis=1)
        counts += np.bincount(nearest, minlength=len(centroids))
        np.add.at(sums, nearest, tree.points[rest])


def assigned(tree: Tree, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each point and its squared distance."""
    balls, rest = tree.split(centroids)
    nearest = np.zeros(len(tree.points), np.int64)
    for ball, c in balls:
        nearest[tree.first[ball] : tree.first[ball] + tree.count[ball]] = c
    if len(rest):
        nearest[rest] = distances(tree.points[rest], centroids).argmin(axis=1)
    return nearest, np.square(tree.points - centroids[nearest]).sum(axis=1)


def _trees(rows: DataFrame, dim: int, scale: int, tree_rows: int) -> DataFrame:
    """A row a tree: the ids in its order and its arrays as bytes."""

    def grow(ids: list[pd.Series], vectors: list[np.ndarray]) -> pd.DataFrame:
        order, tree = Tree.grow(np.concatenate(vectors))
        return pd.DataFrame([{"ids": pd.concat(ids).iloc[order].tolist()} | tree.to_row()])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vectors, n = [], [], 0
        for batch in batches:
            for b in range(0, len(batch), tree_rows):
                part = batch.iloc[b : b + tree_rows]
                known = part["vec_id"].astype(object)
                ids.append(known.where(known.notna(), None))
                vectors.append(whole(np.stack(part["vector"].tolist()), scale))
                n += len(part)
                if n >= tree_rows:
                    yield grow(ids, vectors)
                    ids, vectors, n = [], [], 0
        if n:
            yield grow(ids, vectors)

    kinds = ", ".join(f"{c} binary" for c in ("points", "first", "count", "child", "radius", "sums"))
    return rows.select(F.col("vec_id").cast("string").alias("vec_id"), "vector").mapInPandas(run, f"ids array<string>, {kinds}")


def _over_trees(trees: DataFrame, dim: int, visit: Callable[[Tree, list], pd.DataFrame | None], end: Callable[[], pd.DataFrame | None], schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, row in batch.iterrows():
                if (out := visit(Tree.of_row(row, dim), row["ids"])) is not None:
                    yield out
        if (out := end()) is not None:
            yield out

    return trees.mapInPandas(run, schema)


def _round(trees: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """The centroids after one round."""
    k = len(centroids)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)

    def visit(tree: Tree, ids: list) -> None:
        part_of(tree, centroids, counts, sums)

    def end() -> pd.DataFrame:
        used = np.flatnonzero(counts)
        return pd.DataFrame({"cluster": used, "n": counts[used], "sums": list(sums[used])})

    parts = _over_trees(trees, dim, visit, end, "cluster int, n long, sums array<long>")
    totals = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)])
    out = centroids.copy()
    for row in totals.collect():  # a row a centroid
        out[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(dim)]
    return out


def clustered(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = "2", tree_rows: int = TREE_ROWS) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the fit rows of ``vectors`` (vec_id,
    embedding; other columns are ignored).

    Vectors of another length, null ones, and those with null or non-finite components have no row; zero vectors do.
    Rows that repeat an id or a vector are vectors of their own.  The first centroids are the ``k`` rows of smallest
    hash of seed and id, repeated ids in order of their vectors; a null id is hashed as the empty text.  Fewer rows than
    ``k`` give fewer centroids, and an empty table gives an empty result.  Ties go to the smaller number.  Components of
    524,288 and more are an error, as their squared distances may not fit a long.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")).where(fit_for(F.col("vector"), dim))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = rows.select(hashed.alias("h"), "vector").orderBy("h", "vector").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return vectors.sparkSession.createDataFrame([], schema)
    centroids = whole(np.array([r["vector"] for r in first], np.float64), scale)
    trees = materialize(_trees(rows, dim, scale, tree_rows), "trees")
    for _ in range(rounds):
        centroids = _round(trees, centroids, dim)

    def visit(tree: Tree, ids: list) -> pd.DataFrame:
        nearest, away = assigned(tree, centroids)
        return pd.DataFrame({"vec_id": ids, "cluster": nearest, "distance": away})

    found = _over_trees(trees, dim, visit, lambda: None, "vec_id string, cluster int, distance long")
    found = materialize(found.withColumn("vec_id", F.col("vec_id").cast("long")), "clusters")
    sums = {r["cluster"]: int(r["s"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    named = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    about = vectors.sparkSession.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every vector; unfit vectors, ties and repeats as ``clustered`` says."""
    return clustered(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    floor = lambda s, n: f"(({s}) - ((({s}) % {n}) + {n}) % {n}) // {n}"
    apart = f"CAST(list_sum(list_transform(range(1, {DIM + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i]))) AS BIGINT)"
    steps = [
        f"vectors AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, embedding) - 1 AS cluster, v AS c FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, embedding, v FROM vectors ORDER BY h, embedding LIMIT {CENTROIDS}))",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, cluster)) AS best FROM (SELECT r, vec_id, v, cluster, {apart} AS d FROM vectors, c{i}) GROUP BY r)")
        if i < ROUNDS:
            steps.append(
                f"s{i} AS MATERIALIZED (SELECT cluster, list({floor('s', 'n')} ORDER BY i) AS c FROM (SELECT best[2] AS cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{i}, range(1, {DIM + 1}) AS t(i) GROUP BY ALL) GROUP BY cluster),"
                f" c{i + 1} AS MATERIALIZED (SELECT c{i}.cluster, coalesce(s{i}.c, c{i}.c) AS c FROM c{i} LEFT JOIN s{i} ON c{i}.cluster = s{i}.cluster)"
            )
    last = f"c{ROUNDS}"
    return (
        "WITH " + ",\n".join(steps) + f"\nSELECT vec_id, CAST({last}.cluster AS INTEGER) AS cluster, best[1] AS distance, CAST(sum(best[1]) OVER (PARTITION BY {last}.cluster) AS BIGINT) AS cluster_inertia,"
        f" CAST(sum(best[1]) OVER () AS BIGINT) AS inertia, sha256(array_to_string({last}.c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN {last} ON best[2] = {last}.cluster"
    )


OP12_SQL = _sql()
