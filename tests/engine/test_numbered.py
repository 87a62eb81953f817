"""Numbers within a key of any size against a plain sort."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from velograph.operators.joins import numbered


def test_numbers_equal_a_sort(spark):
    draw = random.Random(4)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.choice([1, None]), draw.randrange(40), i) for i in range(900)]
    frame = spark.createDataFrame(rows, "k string, j int, x int, i int").repartition(5)
    out = numbered(frame, ["k", "j"], [F.desc("x"), "i"], "n")
    assert out.columns == ["k", "j", "x", "i", "n"]
    got = {r.i: r.n for r in out.collect()}
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[2], r[3]))
        assert [got[r[3]] for r in own] == list(range(1, len(own) + 1))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert all("_range" in line for line in plan.split("\n") if "Window [row_number" in line)
    assert numbered(frame.limit(0), ["k"], ["i"], "n").collect() == []
