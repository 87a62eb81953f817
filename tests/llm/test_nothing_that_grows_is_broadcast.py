"""Sides that grow with the input meet in shuffles, at any size: what Spark broadcasts by itself is built in the driver."""

from pyspark.sql import functions as F

from velograph.llm import near_copies
from velograph.llm.op05_simhash import fingerprint_links
from velograph.operators.joins import join_by_share


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_links_of_fingerprints_and_checked_pairs(spark):
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) > 0
    links = fingerprint_links(spark.createDataFrame([(1,), (3,), (1 << 40,)], "fp long"))
    assert "Broadcast" not in _plan(links)
    assert {x for r in links.collect() for x in r} == {1, 3, 1 << 40}
    sets = spark.createDataFrame([(1, 2, [5, 6]), (2, 2, [5, 6]), (3, 1, [9])], "s long, n long, shingles array<long>")
    found = near_copies._verified(spark.createDataFrame([(1, 2), (1, 3)], "a long, b long"), sets)
    assert "Broadcast" not in _plan(found)
    assert [tuple(r) for r in found.collect()] == [(1, 2)]


def test_a_join_of_many_light_keys(spark):
    rows = spark.range(2_000).select(F.col("id").alias("k"))
    keyed = rows.select("k", (F.col("k") * 2).alias("v"), F.lit(1).alias("n"))
    joined = join_by_share(rows, keyed, ["k"], "n", 2_000)
    assert "Broadcast" not in _plan(joined)
    assert joined.where("v = 2 * k").count() == 2_000
