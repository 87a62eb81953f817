"""Linking fragments of one vehicle's track: range join, gates, mutual best, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograph.operators.components import connected_components
from velograph.operators.joins import SHUFFLED, mutual_best, numbered, range_pairs
from velograph.plans.materialize import materialize


def link_pairs(ends: DataFrame, *, max_gap: float = 0.4, max_distance: float = 20.0, max_lateral: float = 4.0, max_speed: float = 45.0) -> DataFrame:
    """Pairs (a, b) of ``tracks.endpoints`` rows where b may go on where a ended, with gap, dist, lateral and passes.

    A pair is a candidate if b begins after a's end, at most ``max_gap`` later, some way off.  The gates are distance,
    sideways offset (along x: the road runs along y), implied speed, and direction: where a has a velocity of 1 or more
    and the distance is 1 or more, b must not lie behind.  Velocities are those of the endpoints' coordinates; give
    endpoints in world coordinates for velocities in metres.
    """
    a = ends.select("run_id", *[F.col(c).alias(f"a_{c}") for c in ("track_id", "first_frame", "last", "vx", "vy", *[c for c in ends.columns if c == "_next"])])
    b = ends.select("run_id", *[F.col(c).alias(f"b_{c}") for c in ("track_id", "first_frame", "first")])
    pairs = range_pairs(a, b, F.col("a_last.t"), F.col("a_last.t") + max_gap, F.col("b_first.t"), max_gap, ["run_id"])
    dx, dy = F.col("b_first.x") - F.col("a_last.x"), F.col("b_first.y") - F.col("a_last.y")
    pairs = pairs.withColumns({"gap": F.col("b_first.t") - F.col("a_last.t"), "dist": F.hypot(dx, dy), "lateral": F.abs(dx), "_dot": dx * F.col("a_vx") + dy * F.col("a_vy")})
    pairs = pairs.where((F.col("a_track_id") != F.col("b_track_id")) & ~F.isnan("dist") & (F.col("dist") > 0) & (F.col("dist") < float("inf")))
    free = F.col("a_vx").isNull() | F.col("a_vy").isNull() | (F.col("dist") < 1) | (F.hypot("a_vx", "a_vy") < 1)
    passes = (F.col("gap") <= max_gap) & (F.col("dist") <= max_distance) & (F.col("lateral") <= max_lateral) & (F.col("dist") <= F.col("gap") * max_speed) & (free | (F.col("_dot") > 0))
    return pairs.withColumn("passes", F.coalesce(passes, F.lit(False))).drop("_dot")


#: Of passing pairs, the first in this order is the best.
BEST: list[Column | str] = ["gap", "lateral", "dist", "a_first_frame", "a_track_id", "b_first_frame", "b_track_id"]


def accepted_links(pairs: DataFrame) -> DataFrame:
    """Passing pairs with accepted: the best of both their tracks by gap, sideways offset and distance."""
    return mutual_best(pairs.where("passes"), ["run_id", "a_track_id"], ["run_id", "b_track_id"], BEST)


def links(ends: DataFrame, **limits: float) -> DataFrame:
    """``accepted_links`` of the ``link_pairs`` of ``ends``, a row a track, with ``limits``.

    Pairs are as many as tracks begin near each end in time, so they are made twice, once for the best of each track and
    again to be marked, and never dealt out or sorted as a whole.
    """
    ends = materialize(ends, "ends")
    pairs = link_pairs(ends, **limits).where("passes").withColumn("_order", F.struct(*BEST))
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.col(c).alias("own"), F.col("_order").alias("order")) for n, c in enumerate(("a_track_id", "b_track_id"))])
    best = pairs.select("run_id", F.inline(sides)).groupBy("run_id", "side", "own").agg(F.min("order").alias("o"))
    # a pair that both its tracks have as their best comes up twice
    mutual = best.groupBy("run_id", F.col("o.a_track_id").alias("track_id"), F.col("o.b_track_id").alias("_next")).agg(F.count("*").alias("_n")).where("_n = 2").drop("_n")
    marked = link_pairs(ends.join(mutual.hint(SHUFFLED), ["run_id", "track_id"], "left"), **limits).where("passes")
    return marked.withColumn("accepted", F.col("a__next").isNotNull() & (F.col("a__next") == F.col("b_track_id"))).drop("a__next")


def merged_vehicles(ends: DataFrame, links: DataFrame) -> DataFrame:
    """(run_id, track_id, component, vehicle_index): the tracks of groups of two or more, each with the vehicle of the
    group's earliest track that has one; groups without any are left out."""
    edges = links.where("accepted").select(F.struct("run_id", F.col("a_track_id").alias("track_id")).alias("a"), F.struct("run_id", F.col("b_track_id").alias("track_id")).alias("b"))
    parts = connected_components(edges).select(F.col("node.run_id").alias("run_id"), F.col("node.track_id").alias("track_id"), F.col("component.track_id").alias("component"))
    members = ends.join(parts, ["run_id", "track_id"])
    known = F.col("vehicle_index").isNotNull()
    rank = F.when(known, F.struct("first_frame", "track_id"))
    named = members.groupBy("run_id", "component").agg(F.min_by(F.when(known, F.col("vehicle_index")), rank).alias("vehicle_index"))
    return members.select("run_id", "track_id", "component").join(named.where("vehicle_index is not null"), ["run_id", "component"]).select("run_id", "track_id", "component", "vehicle_index")


def apply_links(summaries: DataFrame, merged: DataFrame) -> DataFrame:
    """``summaries`` with the vehicle of each linked track."""
    new = merged.select("run_id", "track_id", F.col("vehicle_index").alias("_v"))
    return summaries.join(new, ["run_id", "track_id"], "left").withColumn("vehicle_index", F.coalesce("_v", "vehicle_index")).drop("_v")


def link_audit(ends: DataFrame, links: DataFrame, merged: DataFrame) -> DataFrame:
    """One row a run: status and counts of tracks, vehicles before and after, groups, merged tracks and ambiguous pairs."""
    tracks = ends.groupBy("run_id").agg(F.count("*").alias("input_track_count"), F.count_distinct("vehicle_index").alias("input_vehicle_count"))
    after = apply_links(ends, merged).groupBy("run_id").agg(F.count_distinct("vehicle_index").alias("output_vehicle_count"))
    groups = merged.groupBy("run_id").agg(F.count_distinct("component").alias("merge_group_count"), F.count("*").alias("merged_track_count"))
    rest = links.groupBy("run_id").agg(F.count_if(~F.col("accepted")).alias("ambiguous_pair_count"))
    rows = tracks.join(after, "run_id").join(groups, "run_id", "left").join(rest, "run_id", "left")
    return rows.fillna(0, ["merge_group_count", "merged_track_count", "ambiguous_pair_count"]).withColumn("status", F.lit("linked"))


def link_evidence(links: DataFrame, merged: DataFrame) -> DataFrame:
    """A row for each passing pair of a run: kind ``merged`` with its group's first track and vehicle, or ``ambiguous``.

    The pair's gap, distance, sideways offset and implied speed are what it was judged by.  Accepted pairs of groups
    without a vehicle name none.  Only accepted pairs, at most one a track, meet their groups; the others stay where they are.
    """
    group = merged.select("run_id", F.col("track_id").alias("a_track_id"), "component", F.col("vehicle_index").alias("canonical_vehicle_index"))
    named = links.where("accepted").join(group, ["run_id", "a_track_id"], "left").unionByName(links.where("not accepted"), allowMissingColumns=True)
    own = lambda c: F.when(F.col("accepted"), F.col(c))
    return named.select(
        "run_id", F.when(F.col("accepted"), "merged").otherwise("ambiguous").alias("kind"), own("component").alias("group"), own("canonical_vehicle_index").alias("canonical_vehicle_index"),
        F.col("a_track_id").alias("from_track_id"), F.col("b_track_id").alias("to_track_id"), F.col("gap").alias("gap_seconds"), F.col("dist").alias("distance"), F.col("lateral").alias("lateral_offset"),
        F.when(F.col("gap") > 0, F.col("dist") / F.col("gap")).alias("implied_speed"),
    )


def order_of_tracks(summaries: DataFrame) -> DataFrame:
    """``place`` of each track in its run by (first_frame, track_id)."""
    return numbered(summaries, ["run_id"], ["first_frame", "track_id"], "place")
