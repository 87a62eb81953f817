"""Pairs of spawns and lost trajectories are neither dealt out nor sorted."""

from __future__ import annotations

from pyspark.sql import functions as F

from velograph.operators import joins, tracker


def test_the_best_of_each_spawn_is_marked_without_a_window(spark):
    lost = spark.sql("select 'r' run_id, id track_id, 0D t, double(id % 5) x, 0D y, 0.5D vx, 0D vy from range(40)")
    spawns = spark.sql("select 'r' run_id, id spawn_id, 1D t, double(id) x, 0D y from range(3)")
    out = tracker.rescue_pairs(spawns, lost)
    got = {r.spawn_id: r.track_id for r in out.where("chosen").collect()}
    # expected places are id % 5 + 0.5; of equal distances the smallest track
    assert out.count() == 120 and got == {0: 0, 1: 0, 2: 1}
    assert "Window" not in out._jdf.queryExecution().toString()


def test_a_join_in_parts_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(joins, "PAIRS", 10)
    left = spark.range(60).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(45).select((F.col("id") % 3).alias("k"), F.col("id").alias("b"))
    got = sorted(map(tuple, joins.join_in_parts(left, right, ["k"]).collect()))
    assert got == sorted((i % 2, i, j) for i in range(60) for j in range(45) if i % 2 == j % 3)
