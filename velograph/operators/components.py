"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograph.operators.joins import join_by_share
from velograph.plans.materialize import materialize, release


def _with_least(edges: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """``edges`` (u, v) with ``least``, the smallest of u and its neighbours, and the table that this comes from."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("least"), "degree")
    least = materialize(least, "least")
    return join_by_share(edges, least, ["u"], "degree", total), least


def _sums(edges: DataFrame) -> tuple:
    """Number and order-free hash of the edges: equal before and after a round only if nothing changed."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    return tuple(row)


def _stars(edges: DataFrame) -> DataFrame:
    """(node, component) of edges (u, root), the roots included."""
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())


def connected_components(edges: DataFrame, a: str | Column = "a", b: str | Column = "b") -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    Alternates large-star and small-star rounds until the edges are stars around the smallest node.  The minimum of a
    node's neighbours is a partial aggregate and is joined back; nodes with a large share of the edges are broadcast to
    them, so none of these meets its neighbours in one task.  Each round's edges are written to the shared folder and
    those before them deleted.  A round that changes an edge lowers an end of it, so rounds end by themselves; they
    number about the logarithm of the nodes.  Self-loops, repeated edges and edges with a null end are dropped; nodes
    with no other edge do not appear.  Nodes may be of any ordered type.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    ends = edges.select(a.alias("x"), b.alias("y")).where("x <> y")
    now = materialize(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "edges")
    before = _sums(now)
    if before[0] == 0:
        return _stars(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        star, least = _with_least(both, 2 * before[0])
        large = materialize(star.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct(), "edges")
        release(least)
        small, least = _with_least(large, before[0])
        pulled = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e")).select("e.*")
        last, now = now, materialize(pulled.where("u <> v").distinct(), "edges")
        release(last, large, least)
        if (after := _sums(now)) == before:
            return _stars(now)
        before = after
