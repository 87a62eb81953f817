"""Near-duplicate embeddings with product quantisation: coarse lists, residual codes, and bounds that lose no pair.

Vectors are scaled to length one, where a cosine of ``threshold`` is a distance of ``reach``.  Coarse centroids deal them
into inverted lists; what remains after the centroid is cut into subspaces, each coded by its nearest codeword.  With a
code goes its error, the distance between the vector and what the code stands for.

* Probes are as many as suffice.  If x lies in the list of c and y within ``reach`` of x, then y is at most ``reach`` beyond
  the plane halfway between c and y's own centroid; y probes all lists for which that holds.
* In a list, distances from y to the coded vectors are sums over lookup tables of y's distances to the codewords.  x can be
  within ``reach`` only if that sum is within ``reach`` plus x's error.
* What passes is compared exactly, on the vectors as given.

So no pair is missed whatever the centroids and codewords, which come from a bounded sample; these only decide how much is
compared.  Equal vectors of a label are one vector with a count.  A list of a label is dealt into parts of bounded size, and
so are those that probe it, and each tile of part by part is read as a stream.  A tile gives the number of links of each
vector and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm.op01_forest import valid
from velograph.llm.streamed import dealt, groups
from velograph.llm.tables import table
from velograph.operators.components import connected_components
from velograph.operators.joins import join_by_share
from velograph.plans.materialize import materialize, release

THRESHOLD = 0.98
#: Vectors of the sample at most, and the bytes they take at most, whichever is less.
SAMPLE, SAMPLE_BYTES = 16_384, 64 << 20
#: A list for so many vectors, and lists at most; a list is cut into parts, so this bounds no work.
LIST_ROWS, LISTS = 4_096, 1_024
SUBSPACES, CODEWORDS = 8, 256
STEPS = 4
#: Bytes of vectors in a part of a list; a tile has four parts of those that probe it.
PART_BYTES = 4 << 20
BATCH = 256
MARGIN = 1e-6


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors scaled to length one; scaling by a power of two first keeps squares from over- and underflowing."""
    v = vectors.astype(np.float64)
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1))[1][:, None])
    return v / np.sqrt(np.square(v).sum(axis=1))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows of ``a`` with the same rows of ``b``, in double precision."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) for x in (a, b))
    return np.einsum("nd,nd->n", a, b) / (np.sqrt(np.square(a).sum(axis=1)) * np.sqrt(np.square(b).sum(axis=1)))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(np.square(a).sum(axis=1)[:, None] - 2 * (a @ b.T) + np.square(b).sum(axis=1), 0)


def _means(points: np.ndarray, k: int) -> np.ndarray:
    """``k`` centroids by a few rounds from the first points, which are in an order without meaning."""
    centre = points[:k].copy()
    for _ in range(STEPS):
        near = _squares(points, centre).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=points[:, j], minlength=k) for j in range(points.shape[1])], axis=1)
        centre[n > 0] = sums[n > 0] / n[n > 0, None]
    return centre


class Quantiser:
    """Centroids of the lists and codewords of the subspaces for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, codewords: int = CODEWORDS):
        self.centroids = _means(sample, max(1, min(lists, len(sample) // 8)))
        self.cuts = [x for x in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(x)]
        rest = sample - self.centroids[_squares(sample, self.centroids).argmin(axis=1)]
        self.words = [_means(rest[:, cut], max(1, min(codewords, len(sample) // 4))) for cut in self.cuts]
        self.apart = np.sqrt(_squares(self.centroids, self.centroids))

    def placed(self, u: np.ndarray, reach: float) -> tuple[np.ndarray, list[np.ndarray]]:
        """The list of each vector, and all lists in which something within ``reach`` of it may be."""
        away = _squares(u, self.centroids)
        home = away.argmin(axis=1)
        beyond = away - away[np.arange(len(u)), home][:, None]
        return home, [np.flatnonzero(x) for x in beyond <= 2 * (reach + MARGIN) * self.apart[home] + MARGIN]

    def coded(self, u: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A byte a subspace, and the distance to what these stand for."""
        rest = u - self.centroids[home]
        codes = np.stack([_squares(rest[:, cut], words).argmin(axis=1) for cut, words in zip(self.cuts, self.words, strict=True)], axis=1)
        for i, (cut, words) in enumerate(zip(self.cuts, self.words, strict=True)):
            rest[:, cut] -= words[codes[:, i]]
        return codes.astype(np.uint8), np.sqrt(np.square(rest).sum(axis=1))

    def lookups(self, u: np.ndarray, list_: int, codes: np.ndarray) -> np.ndarray:
        """Distances of vectors to what codes of one list stand for, from tables of each vector's distances to the codewords."""
        rest = u - self.centroids[list_]
        out = np.zeros((len(u), len(codes)))
        for i, (cut, words) in enumerate(zip(self.cuts, self.words, strict=True)):
            out += _squares(rest[:, cut], words)[:, codes[:, i]]
        return np.sqrt(out)


def fitted(distinct: DataFrame, lists: int | None) -> dict[int, Quantiser]:
    """A quantiser for each length of vector in a sample of at most ``SAMPLE`` vectors and ``SAMPLE_BYTES``."""
    total, longest = distinct.agg(F.count("*"), F.max("dim")).first()
    if not total:
        return {}
    rows = distinct.orderBy("c1", "c2").select("dim", "vector").limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * longest)))).toPandas()
    out = {}
    for dim, part in rows.groupby("dim"):
        wanted = lists or min(LISTS, ceil(total * len(part) / len(rows) / LIST_ROWS))
        out[int(dim)] = Quantiser(unit(np.stack(part["vector"].tolist())), wanted)
    return out


def _forest(hits: np.ndarray, near: list[np.ndarray], own: np.ndarray, asking: np.ndarray, root: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join what ``near`` joins; ``root`` has the component of each of ``own`` so far and is kept up to date."""
    for i, others in zip(hits.tolist(), near, strict=True):
        roots, first = np.unique(root[others], return_index=True)
        for j in others[first].tolist():
            if own[j] != asking[i]:
                yield int(asking[i]), int(own[j])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]


def _tile(list_: int, pieces: Iterator[pd.DataFrame], quantiser: Quantiser, kind: str, threshold: float) -> Iterator[pd.DataFrame]:
    """Numbers of links (a, null, n) and links (a, b, null) of those that probe one part of a list; the part comes first."""
    reach = sqrt(2 - 2 * threshold)
    stored: list[pd.DataFrame] = []
    own = v = codes = error = rows = root = None
    for piece in pieces:
        there = piece["asks"].to_numpy() == 0
        if there.any():
            stored.append(piece[there])
        if there.all():
            continue
        if own is None:
            if not stored:
                return
            part = pd.concat(stored)
            own, rows, error = (part[c].to_numpy() for c in ("node", "rows", "error"))
            v = np.frombuffer(b"".join(part["v"]), kind).astype(np.float64).reshape(len(part), -1)
            codes = np.frombuffer(b"".join(part["codes"]), np.uint8).reshape(len(part), -1)
            root = np.arange(len(own))
        asking = piece[~there]
        for at in range(0, len(asking), BATCH):
            some = asking.iloc[at : at + BATCH]
            ids = some["node"].to_numpy()
            q = np.frombuffer(b"".join(some["v"]), kind).astype(np.float64).reshape(len(some), -1)
            i, j = np.nonzero(quantiser.lookups(unit(q), list_, codes) <= reach + error + MARGIN)
            sure = np.empty(len(i), bool)
            for b in range(0, len(i), 16_384):
                sure[b : b + 16_384] = cosines(q[i[b : b + 16_384]], v[j[b : b + 16_384]]) >= threshold
            sure &= ids[i] != own[j]
            i, j = i[sure], j[sure]
            if not len(i):
                continue
            hits, starts = np.unique(i, return_index=True)
            links = list(_forest(hits, np.split(j, starts[1:]), own, ids, root))
            yield pd.DataFrame({"a": ids[hits], "n": np.add.reduceat(rows[j], starts)}).assign(b=pd.array([None] * len(hits), "Int64"))[["a", "b", "n"]]
            if links:
                yield pd.DataFrame(links, columns=["a", "b"]).assign(n=pd.array([None] * len(links), "Int64"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, *, lists: int | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label; others are ignored).

    Rows link if their labels are equal and not null, their vectors have one length and a cosine of ``threshold`` or more.
    Null, zero, and partly null or non-finite vectors link with nothing, nor do rows without a label.  Rows that repeat a
    vector or an id are rows of their own and count as links of each other.  component_id is the smallest vec_id
    reachable; a null one stays null unless it reaches another.  kept says whether that is the row's own id, null equal to
    null.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("label"))
    takes = F.col("label").isNotNull() & valid(F.col("vector"))
    named = rows.select("vec_id", "label", takes.alias("takes"), F.xxhash64("vector").alias("c1"), F.xxhash64(F.lit(1), "vector").alias("c2"), "vector")
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    distinct = named.where("takes").groupBy("label", "c1", "c2").agg(F.first("vector").alias("vector"), F.count("*").alias("rows"), F.min("vec_id").alias("least"))
    distinct = materialize(distinct.select("*", F.size("vector").alias("dim"), F.monotonically_increasing_id().alias("node")), "vectors")
    index = spark.sparkContext.broadcast(fitted(distinct, lists))  # of a bounded size
    reach = sqrt(2 - 2 * threshold)
    part_rows = F.greatest(F.lit(64), F.floor(F.lit(part_bytes) / (F.lit(int(kind[-1])) * F.col("dim"))))

    def quantiser(dim: int) -> Quantiser:
        return index.value.get(dim) or index.value.setdefault(dim, Quantiser(np.zeros((1, dim)), 1))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                v, q = np.stack(part["vector"].tolist()), quantiser(int(dim))
                u = unit(v)
                home, probes = q.placed(u, reach)
                codes, error = q.coded(u, home)
                own = part[["label", "dim", "node", "rows"]]
                yield own.assign(list=home.astype(np.int32), codes=[x.tobytes() for x in codes], error=error, v=[x.tobytes() for x in v.astype(kind)], probes=probes)

    coded = distinct.select("label", "dim", "node", "rows", "vector").mapInPandas(encode, "label string, dim int, node long, rows long, list int, codes binary, error double, v binary, probes array<int>")
    coded = materialize(coded, "codes")
    cell = ["label", "dim", "list"]
    probing = coded.select("label", "dim", F.explode("probes").alias("list"), "node", "v")
    asked = probing.groupBy(*cell).agg(F.count("*").alias("asked"))
    cells = coded.groupBy(*cell).agg(F.count("*").alias("n")).join(asked, cell)
    cells = cells.select(*cell, "n", "asked", F.ceil(F.col("n") / part_rows).cast("int").alias("parts"), F.ceil(F.col("asked") / (4 * part_rows)).cast("int").alias("shares"))
    cells = materialize(cells, "cells")
    sizes = cells.agg(F.sum("n"), F.sum("asked")).first()
    salt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    stored = join_by_share(coded.drop("probes"), cells.drop("asked"), cell, "n", sizes[0] or 0)
    stored = stored.select(*cell, salt("parts").alias("part"), each("shares").alias("share"), F.lit(0).alias("asks"), "node", "rows", "codes", "error", "v")
    probing = join_by_share(probing, cells.drop("n"), cell, "asked", sizes[1] or 0)
    probing = probing.select(*cell, each("parts").alias("part"), salt("shares").alias("share"), F.lit(1).alias("asks"), "node", F.lit(0).cast("long").alias("rows"), F.lit(None).cast("binary").alias("codes"), F.lit(0.0).alias("error"), "v")
    keys = [*cell, "part", "share"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, pieces in groups(batches, keys):
            yield from _tile(int(key[2]), pieces, quantiser(int(key[1])), kind, threshold)

    found = materialize(dealt(stored.unionByName(probing), keys, ["asks", "node"]).mapInPandas(run, "a long, b long, n long"), "found")
    parts = connected_components(found.where("b is not null"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links"))
    nodes = distinct.select("node", "label", "c1", "c2", "rows", "least").join(links, "node", "left").join(parts, "node", "left")
    nodes = nodes.select("label", "c1", "c2", "rows", "least", (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    nodes = materialize(nodes, "nodes")
    smallest = materialize(nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "smallest")
    whole = join_by_share(nodes, smallest, ["root"], "members", nodes.count()).select("label", "c1", "c2", "rows", "n_links", "component_id")
    whole = materialize(whole, "whole")
    release(coded, cells)
    ids = named.select("vec_id", "label", "c1", "c2", "takes")
    linked = join_by_share(ids.where("takes"), whole, ["label", "c1", "c2"], "rows", ids.count()).select("vec_id", "n_links", "component_id")
    every = linked.union(ids.where("not takes").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    return every.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector; unfit vectors, ties and repeats as ``near_duplicates`` says."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP13_SQL = f"""
WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v,
         label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
         AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS takes FROM embeddings),
links AS MATERIALIZED (
  SELECT a.r AS a, b.r AS b FROM vectors a JOIN vectors b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE a.takes AND b.takes AND CASE WHEN a.takes AND b.takes AND len(a.v) = len(b.v)
        THEN list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= {THRESHOLD} END),
reached AS (
  SELECT r AS a, r AS b FROM vectors UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
least AS (SELECT a AS r, min(vec_id) AS component_id FROM reached JOIN vectors ON reached.b = vectors.r GROUP BY a),
counts AS (SELECT a AS r, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM vectors JOIN least USING (r) LEFT JOIN counts USING (r)
"""
