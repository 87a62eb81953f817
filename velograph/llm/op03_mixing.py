"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / size of the source`` times.  The expected copies are summed along an
order of the source, one random offset is added, and a document is taken once for each integer that its stretch of the
sum crosses.  The order is by size, so the words taken differ from the target by about one document at most.

All documents of a source are expected equally often, so the prefix sum is the document's rank times that number, and
only the rank has to be found.  A source, and one size within it, may hold any share of all rows; ranks are therefore
put together from counts: rows are numbered only within (source, size, salt), and the counts before such a cell are
summed in three short steps (sizes in blocks of ``SPAN``, sizes within a block, salts within a size).  The salt is a digest
of id and text, and there are as many salts as the table needs.  Sources may be many, such as web hosts: what runs over all
of them is a running sum by ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velograph.llm.tables import WORD, table
from velograph.operators.joins import SHUFFLED, join_by_share
from velograph.plans.materialize import materialize

WEIGHTS = (3, 1, 2)
#: Salts are at least so many, and so many that each has about this many rows of the table.
SALTS, SALT_ROWS = 64, 1_000_000
SPAN = 128
SEED = "velograph mix 1"


def running(rows: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """``rows`` with, for each named sum, that of a column over the rows before in ``order``.

    The rows are sorted into ranges and written; sums run within a range, and the ranges' totals, one row a range, give what
    is before each.
    """
    dealt = materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    totals = totals.select("_range", *[F.coalesce(F.sum(f"_{n}").over(across), F.lit(0)).alias(f"_{n}") for n in sums])
    own = dealt.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(totals), "_range")
    return own.withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).drop("_range", *[f"_{n}" for n in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) of (source, source_size), one row for each source; a null source is a source.

    Sources by code point, null last, have the weights in turn.  They share ``share`` (a fraction) of all sizes; what a
    source would get beyond ``most`` times its size is shared again by weight.  Sorted by size against weight, a source
    is full as long as its bound is under its part of what the sources before it left: one pass over a row a source.
    """
    rows = running(sizes.select("source", "source_size", F.lit(1).alias("one")), [F.col("source").isNull(), F.col("source")], i="one")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights)).cast("int") + 1).cast("long")
    rows = rows.withColumn("w", weight).withColumn("bound", (most * F.col("source_size")).cast("long"))
    rows = running(rows, [F.col("bound") / F.col("w"), F.col("i")], before="bound", passed="w")
    rows = materialize(rows, "filled")
    total, weigh = rows.agg(F.sum("source_size"), F.sum("w")).first()
    rows = rows.withColumn("left", F.lit(float(share[0] * (total or 0)) / share[1]) - F.col("before")).withColumn("weights", F.lit(weigh or 0) - F.col("passed"))
    rows = rows.withColumn("full", (F.col("bound") * F.col("weights")).cast("double") <= F.col("left") * F.col("w"))
    first = rows.where("not full").agg(F.min(F.struct((F.col("bound") / F.col("w")).alias("r"), "i", "left", "weights"))).first()[0]
    level = F.lit(first["left"]) * F.col("w") / F.lit(float(first["weights"])) if first else F.lit(0.0)
    return rows.select("source", "source_size", F.when(F.col("full"), F.col("bound").cast("double")).otherwise(level).alias("target"))


def offset_of(source: Column, seed: str = SEED) -> Column:
    """A number from 0 up to 1 for each source, from a digest of its name; a null source has one of its own."""
    name = F.md5(F.concat(F.lit(seed), F.when(source.isNull(), F.lit("/")).otherwise(F.concat(F.lit(":"), source))).cast("binary"))
    return F.conv(F.substring(name, 1, 13), 16, 10).cast("double") / float(1 << 52)


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies, taken) for every row of ``docs`` (doc_id, text, source).

    Null texts have size 0, and texts count whole.  Repeated rows are documents of their own; ids may be null.  An empty
    table gives an empty result, and a source without words takes nothing.
    """
    digest = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))).cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), digest.alias("digest"))
    rows = materialize(rows, "sizes")  # the texts are read once
    total = rows.count()
    salts = max(SALTS, -(-total // SALT_ROWS))
    rows = rows.withColumn("salt", F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long"), F.lit(salts)).cast("int"))
    rows = rows.withColumn("s", F.coalesce(F.concat(F.lit(":"), "source"), F.lit("/")))  # a key without nulls
    cells = rows.groupBy("s", "size", "salt").agg(F.count("*").alias("n"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inner = cells.withColumn("b1", F.coalesce(F.sum("n").over(before("s", "size").orderBy("salt")), F.lit(0)))
    by_size = cells.groupBy("s", "size").agg(F.sum("n").alias("n")).withColumn("block", F.floor(F.col("size") / SPAN))
    middle = by_size.withColumn("b2", F.coalesce(F.sum("n").over(before("s", "block").orderBy("size")), F.lit(0)))
    by_block = by_size.groupBy("s", "block").agg(F.sum("n").alias("n"))
    outer = by_block.withColumn("b3", F.coalesce(F.sum("n").over(before("s").orderBy("block")), F.lit(0)))
    firsts = inner.select("s", "size", "salt", "b1").join(middle.select("s", "size", "block", "b2").join(outer.select("s", "block", "b3"), ["s", "block"]), ["s", "size"])
    firsts = firsts.select("s", "size", "salt", (F.col("b1") + F.col("b2") + F.col("b3")).alias("first"))

    sizes = by_size.groupBy("s").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("documents"))
    name = F.when(F.col("s").startswith(":"), F.substring("s", 2, 1 << 30))
    sizes = materialize(sizes, "sources")
    shares = targets(sizes.select(name.alias("source"), "source_size"), weights)
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = shares.select(F.coalesce(F.concat(F.lit(":"), "source"), F.lit("/")).alias("s"), "source_size", "target", expected.alias("r"), offset_of(F.col("source"), seed).alias("u"))
    plan = materialize(plan.join(sizes.select("s", "documents"), "s"), "plan")

    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy("s", "size", "salt").orderBy("digest")))
    out = join_by_share(ranked.join(firsts.hint(SHUFFLED), ["s", "size", "salt"]), plan, ["s"], "documents", total).withColumn("k", F.col("k") + F.col("first"))
    crossed = F.floor(F.col("k") * F.col("r") + F.col("u")) - F.floor((F.col("k") - 1) * F.col("r") + F.col("u"))
    out = out.withColumn("copies", F.least(crossed, F.lit(2)).cast("int"))
    return out.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; nulls, ties and repeats as ``mixture`` says."""
    return mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP3_SQL = rf"""
WITH rows AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))) AS digest FROM documents),
salts AS (
  SELECT greatest({SALTS}, (count(*) + {SALT_ROWS - 1}) // {SALT_ROWS}) AS n FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source COLLATE "BINARY") - 1 AS i FROM rows GROUP BY source),
weighed AS (
  SELECT *, CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 2 * source_size AS bound FROM sizes),
filled AS (
  SELECT *, CAST(3 * sum(source_size) OVER () AS DOUBLE) / 2
              - coalesce(sum(bound) OVER (ORDER BY bound / w, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remaining,
         sum(w) OVER (ORDER BY bound / w, i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights FROM weighed),
marked AS (
  SELECT *, CAST(bound * weights AS DOUBLE) <= remaining * w AS is_full FROM filled),
opened AS (
  SELECT remaining, weights FROM marked WHERE NOT is_full ORDER BY bound / w, i LIMIT 1),
plan AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(bound AS DOUBLE) ELSE (SELECT remaining FROM opened) * w / (SELECT CAST(weights AS DOUBLE) FROM opened) END AS target,
         CAST(CAST('0x' || substr(md5('{SEED}' || CASE WHEN source IS NULL THEN '/' ELSE ':' || source END), 1, 13) AS UBIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM marked),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, CAST('0x' || substr(digest, 1, 8) AS UBIGINT) % (SELECT n FROM salts), digest) AS k FROM rows),
drawn AS (
  SELECT doc_id, size, source_size, target, u, k, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS r
  FROM ranked JOIN plan ON ranked.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, source_size, target, CAST(least(floor(k * r + u) - floor((k - 1) * r + u), 2) * size AS BIGINT) AS taken FROM drawn
"""
