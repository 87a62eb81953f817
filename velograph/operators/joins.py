"""Joins on time and position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velograph.plans.materialize import materialize

#: Keys with more than one in so many of all rows, or in as many as a shuffle has partitions if these are more, are
#: broadcast; there are fewer than this of them.
HEAVY = 500
#: Pairs of a key that one part of a join by parts makes, about.
PAIRS = 1 << 22
#: The hint for sides of joins that grow with the input.  Spark would broadcast them up to a size on disk, which is several
#: times that in the driver, and several joins of a query may do so at once.
SHUFFLED = "merge"


def range_pairs(left: DataFrame, right: DataFrame, from_: Column, to: Column, at: Column, width: float, keys: list[str]) -> DataFrame:
    """Rows of both sides with equal keys and ``from_ < at <= to``.

    Time is cut into buckets of ``width``; a left row goes to each bucket that its range touches and a right row to
    its own, so the join is on equality and each pair is found once.  ``to - from_`` should not be much over ``width``.
    """
    bucket = lambda c: F.floor(c / width)
    spread = left.withColumn("_bucket", F.explode(F.sequence(bucket(from_), bucket(to)))).withColumns({"_from": from_, "_to": to})
    placed = right.withColumns({"_bucket": bucket(at), "_at": at})
    return join_in_parts(spread, placed, [*keys, "_bucket"]).where("_at > _from and _at <= _to").drop("_bucket", "_from", "_to", "_at")


def join_in_parts(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The inner join on equal ``on``, in tasks of about equal numbers of pairs, however many of them a key has.

    A job counts the rows of each key on both sides.  Where a key has more than ``PAIRS`` pairs its left rows are dealt into
    parts and its right rows go to each of them; the keys are fewer than all pairs over ``PAIRS``, and broadcast.  The parts
    are dealt out by number, as sizes of the inputs say nothing about the pairs.  Both sides are written first, as they are
    read twice.
    """
    left, right = materialize(left, "left"), materialize(right, "right")
    count = lambda rows, name: rows.groupBy(*on).agg(F.count("*").alias(name))
    met = count(left, "_l").join(count(right, "_r"), on)
    pairs = F.col("_l").cast("double") * F.col("_r")
    met = materialize(met.withColumns({"_pairs": pairs, "_parts": F.least(F.ceil(pairs / PAIRS), "_l")}), "met")
    total = met.agg(F.sum("_pairs")).first()[0] or 0
    if total <= PAIRS:
        return left.join(right, on)
    heavy = met.where("_parts > 1").select(*on, "_parts")
    parts = F.coalesce("_parts", F.lit(1).cast("long"))
    dealt = left.join(F.broadcast(heavy), on, "left").withColumn("_part", F.pmod(F.xxhash64(*[c for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]), parts)).drop("_parts")
    every = right.join(F.broadcast(heavy), on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    number = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(int(2 * total / PAIRS), 2_000))
    by = [*on, "_part"]
    return dealt.repartition(number, *by).join(every.repartition(number, *by), by).drop("_part")


def asof(left: DataFrame, right: DataFrame, time: str, keys: list[str], columns: list[str]) -> DataFrame:
    """``left`` with ``columns`` of the latest right row whose time is not later; null before the first.

    Both sides are laid into one sequence a key, so each is sorted once; right rows of equal time come first.
    """
    here = F.struct(*left.columns)
    there = F.struct(*columns)
    both = left.select(*keys, F.col(time).alias("_t"), F.lit(1).alias("_side"), here.alias("_row"), F.lit(None).cast(right.select(there.alias("x")).schema["x"].dataType).alias("_found"))
    both = both.unionByName(right.select(*keys, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(here.alias("x")).schema["x"].dataType).alias("_row"), there.alias("_found")))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("_latest", F.last("_found", ignorenulls=True).over(w)).where("_side = 1").select("_row.*", *[F.col(f"_latest.{c}").alias(c) for c in columns])


def join_by_share(rows: DataFrame, keyed: DataFrame, on: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``on`` with ``keyed``, which has one row for each key and in ``count`` its number in ``rows``.

    Fewer than n keys can have more than one in n of all ``total`` rows each, so those keys, found by a job over ``keyed``,
    are broadcast and their rows stay where they are; the others meet in a shuffle join in which no key has more than a
    partition's usual share.  ``keyed`` is read up to three times and had better be a table.
    """
    parts = max(HEAVY, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    name = lambda side: F.xxhash64(*[side[k] for k in on])
    heavy = [r[0] for r in keyed.where(F.col(count) > total / parts).select(name(keyed)).distinct().collect()]
    if not heavy:
        return rows.join(keyed.drop(count).hint(SHUFFLED), on, how)
    inside = rows.where(name(rows).isin(heavy)).join(F.broadcast(keyed.where(name(keyed).isin(heavy)).drop(count)), on, how)
    return inside.unionByName(rows.where(~name(rows).isin(heavy)).join(keyed.where(~name(keyed).isin(heavy)).drop(count).hint(SHUFFLED), on, how))


def numbered(rows: DataFrame, keys: list[str], order: list[Column | str], name: str) -> DataFrame:
    """``rows`` with ``name``: the number of each within its ``keys``, from 1, in ``order``, which leaves no ties open.

    A key may have any number of rows: all rows are dealt by ranges of keys and order and written, numbered within a range,
    and given the rows that the key has in the ranges before, a row a key and range.  Null keys are keys.
    """
    keyed = rows.withColumn("_key", F.struct(*keys))
    dealt = materialize(keyed.repartitionByRange("_key", *order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = F.row_number().over(Window.partitionBy("_range", "_key").orderBy(*order))
    counts = dealt.groupBy(F.col("_range").alias("_r"), F.col("_key").alias("_k")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_r", "_k", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    found = dealt.withColumn("_i", inside).join(before, (F.col("_range") == F.col("_r")) & F.col("_key").eqNullSafe(F.col("_k")))
    return found.select(*rows.columns, (F.col("_i") + F.col("_before")).cast("int").alias(name))


def between_neighbours(rows: DataFrame, position: str, keys: list[str], order: list[str], most: int, carried: list[str]) -> DataFrame:
    """A row for each missing position between neighbours that miss 1 to ``most``: keys, position, ratio, prev, next."""
    w = Window.partitionBy(*keys).orderBy(*order)
    row = F.struct(position, *carried)
    pairs = rows.select(*keys, *order, row.alias("prev")).withColumn("next", F.lead("prev").over(w))
    missing = F.col(f"next.{position}") - F.col(f"prev.{position}") - 1
    filled = pairs.where((missing >= 1) & (missing <= most)).withColumn("_p", F.explode(F.sequence(F.col(f"prev.{position}") + 1, F.col(f"next.{position}") - 1)))
    ratio = (F.col("_p") - F.col(f"prev.{position}")) / (F.col(f"next.{position}") - F.col(f"prev.{position}"))
    return filled.select(*keys, F.col("_p").alias(position), ratio.alias("ratio"), "prev", "next")


def mutual_best(pairs: DataFrame, left: list[str], right: list[str], order: list[Column | str]) -> DataFrame:
    """``pairs`` with accepted: whether the pair is the best of its left and of its right row in ``order``."""
    by = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return pairs.withColumns({"_l": by(left), "_r": by(right)}).withColumn("accepted", (F.col("_l") == 1) & (F.col("_r") == 1)).drop("_l", "_r")


def first_wins(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def active_records(records: DataFrame) -> DataFrame:
    """Records that no other supersedes."""
    gone = records.where("supersedes_record_id is not null").select(F.col("supersedes_record_id").alias("record_id")).distinct()
    return records.join(gone, "record_id", "left_anti")
