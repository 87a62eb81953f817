"""Benchmark decontamination with spaced seeds, in DataFrame functions alone.

Texts and benchmark items become sequences of lower-cased tokens, hashed: runs of letters and digits, and single
characters of the scripts that put no spaces between words.  A document is contaminated by an item if some ``WINDOW``
consecutive tokens of the item line up with tokens of the document and at most ``SUBSTITUTED`` of them differ; an item
of fewer tokens, but at least ``SEEDED``, has to line up as a whole with at most one difference, and one of fewer
still as a whole and exactly.

A mask selects six token positions and ignores the others between them.  For the two masks here, every way of putting
two substitutions into thirteen tokens, or one into nine, leaves one mask untouched at some place in the window, so a
lineup that meets the rule always has a seed in it.  Seeds of both sides are joined on their hash; every hit is then
verified on the tokens around it.  Equal stretches of several items are verified once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm.tables import table
from velograph.plans.materialize import materialize

WINDOW, SUBSTITUTED = 13, 2
SEEDED = 9
MASKS = ((0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 7, 8))
#: Tokens of the benchmark up to which its seeds are broadcast with their stretches (at most 25 hashes each: at most
#: 2 * 25 * 8 bytes a token, about 100 MB).
BROADCAST_TOKENS = 250_000
#: Tokens of a block of a larger benchmark whose bare seeds are broadcast, a pass over the documents for each block;
#: only the places that they let through are then shuffled.
BLOCK_TOKENS = 1_000_000
#: Hashes of contaminated texts, 8 bytes each, that are broadcast at most.
BROADCAST_HASHES = 2_000_000
#: Scripts without spaces between words (Thai, Lao, Myanmar, Khmer, kana, Han) as ranges that Java and RE2 both read.
UNSPACED = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}"


def tokenized(rows: DataFrame, kept: str) -> DataFrame:
    """(kept, t): hashes of the lower-cased tokens of each text; none for a null text."""
    # lower case is a column of its own, so that Spark does not work it out for each place that reads it
    low = rows.select(kept, F.lower(F.coalesce("text", F.lit(""))).alias("_low"))
    text = F.col("_low")
    # a text of as many bytes as characters has no such script, and one range tells most others
    wide = (F.octet_length(text) != F.length(text)) & text.rlike(r"[\x{0E00}-\x{3FFFF}]")
    spaced = F.when(wide, F.regexp_replace(text, f"([{UNSPACED}])", " $1 ")).otherwise(text)
    return low.select(kept, F.transform(F.filter(F.split(spaced, r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)).alias("t"))


def _seeds(rows: DataFrame, kept: str) -> DataFrame:
    """(kept, mask, seed, pos, size, around) for each place of the tokens ``t`` where a mask fits.

    ``around`` holds the tokens from ``pos - WINDOW + 1`` on, 3 * WINDOW - 2 in all, with nulls before the first one.
    Tokens are hashed once for each row; places, masks, seeds and ``around`` are made inside generated code, and
    ``around`` only for what passes a join behind it.  (The outer form keeps Spark from hashing the tokens a second
    time in a filter for rows without any.)
    """
    at = lambda i: F.get("t", F.col("pos") + i)
    places = rows.select(kept, "t", F.posexplode_outer("t").alias("pos", "_first")).where(F.col("pos") + MASKS[0][-1] < F.size("t"))
    seeds = [F.struct(F.lit(k).alias("mask"), F.xxhash64(F.lit(k), *[at(i) for i in m]).alias("seed"), (F.col("pos") + m[-1] < F.size("t")).alias("fits")) for k, m in enumerate(MASKS)]
    every = places.select(kept, "t", "pos", F.explode(F.array(*seeds)).alias("s")).where("s.fits")
    missing = F.greatest(F.lit(0), F.lit(WINDOW - 1) - F.col("pos"))
    inside = F.slice("t", F.greatest(F.lit(1), F.col("pos") - (WINDOW - 2)), F.lit(3 * WINDOW - 2) - missing)
    around = F.concat(F.array_repeat(F.lit(None).cast("long"), missing), inside)
    return every.select(kept, "s.mask", "s.seed", "pos", F.size("t").alias("size"), around.alias("around"))


def _equal_tokens(item: Column, doc: Column, length: Column) -> Column:
    """For each ``length`` consecutive tokens of the item's stretch, how many equal the document's beside them."""
    equal = F.zip_with(item, doc, lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.transform(F.sequence(F.lit(1), F.size(item) - length + 1), lambda i: F.aggregate(F.slice(equal, i, length), F.lit(0), lambda a, x: a + x))


def _exact(items: DataFrame, own: DataFrame) -> DataFrame | None:
    """(doc_id, item_id, matched, window) of the items under ``SEEDED`` tokens, by one hash of all their tokens."""
    lengths = sorted(r[0] for r in items.where((F.size("t") > 0) & (F.size("t") < SEEDED)).select(F.size("t")).distinct().collect())
    if not lengths:
        return None
    known = items.select("item_id", F.size("t").alias("n"), F.xxhash64("t").alias("key"), F.col("t").alias("it"))
    runs = F.array(*[F.lit(n) for n in lengths])
    places = own.select("doc_id", "t", F.posexplode_outer("t").alias("pos", "_first")).select("doc_id", "t", "pos", F.explode(runs).alias("n"))
    found = places.where(F.col("pos") + F.col("n") <= F.size("t")).select("doc_id", "n", F.slice("t", F.col("pos") + 1, F.col("n")).alias("dt"))
    met = found.withColumn("key", F.xxhash64("dt")).join(known.where(F.size("it") < SEEDED), ["n", "key"]).where(F.col("dt") == F.col("it"))
    return met.select("doc_id", "item_id", F.col("n").alias("matched"), F.col("n").alias("window"))


def contaminated(docs: DataFrame, benchmark: DataFrame, *, broadcast_tokens: int = BROADCAST_TOKENS, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, item_id, matched, window): each pair of a document and an item that meet the rule.

    ``window`` is the number of tokens that were lined up and ``matched`` the most of them that are equal.  Null and
    empty texts match nothing, and texts count whole, however long.  Rows with a repeated or null doc_id give one row
    for each item together.  An empty table on either side gives an empty result.  Other columns are ignored.
    """
    every = tokenized(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text"), "item_id")
    items = every.where(F.size("t") >= SEEDED)
    # of an item, the tokens of every window that may hold the seed: at most WINDOW - 1 on either side of its first
    lead = F.least(F.col("pos"), F.lit(WINDOW - 1))
    stretch = F.slice("around", F.lit(WINDOW) - F.col("lead"), F.least(F.col("size") - F.col("pos"), F.lit(WINDOW)) + F.col("lead"))
    known = _seeds(items, "item_id").withColumn("lead", lead).select("mask", "seed", "item_id", "lead", F.least("size", F.lit(WINDOW)).alias("window"), stretch.alias("it"))
    known = known.groupBy("mask", "seed", "lead", "window", "it").agg(F.collect_set("item_id").alias("items"))
    size = items.agg(F.sum(F.size("t"))).first()[0] or 0

    own = tokenized(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id")
    seeds = _seeds(own, "doc_id").select("doc_id", "mask", "seed", "around")
    if size <= broadcast_tokens:
        hits = seeds.join(F.broadcast(known), ["mask", "seed"])
    else:
        blocks = -(-size // block_tokens)
        bare = known.select("mask", "seed").distinct()
        within = [F.broadcast(bare.where(F.pmod("seed", F.lit(blocks)) == i)) for i in range(blocks)]
        hits = reduce(DataFrame.union, [seeds.join(b, ["mask", "seed"], "left_semi") for b in within]).join(known.hint("merge"), ["mask", "seed"])
    lined = hits.select("doc_id", "items", "window", "it", F.slice("around", F.lit(WINDOW) - F.col("lead"), F.size("it")).alias("dt"))
    # one row a window: its count comes out of a generator, so the test below stays behind the join
    counted = lined.select("doc_id", "items", "window", F.explode(_equal_tokens(F.col("it"), F.col("dt"), F.col("window"))).alias("matched"))
    allowed = F.when(F.col("window") >= WINDOW, SUBSTITUTED).otherwise(1)
    met = counted.where(F.col("matched") >= F.col("window") - allowed).select("doc_id", F.explode("items").alias("item_id"), "matched", "window")
    exact = _exact(every, own)
    met = met if exact is None else met.union(exact)
    return met.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.max("window").alias("window"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text meets no item, by the rule of ``contaminated``, all columns kept.

    Items of any length count, short ones as a whole and exactly.  A row is known by a hash of its text, which alone
    decides, so null or repeated ids take no other row along, and repeated rows stay or go together.  Null and empty texts
    stay; an empty table on either side drops nothing.  The hashes of contaminated texts are written and broadcast to the
    documents, which then stay where they are, up to ``BROADCAST_HASHES``; more are joined by a shuffle.
    """
    bad = contaminated(docs.select(F.xxhash64("text").alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias("_velograph_bad")).distinct()
    bad = materialize(bad, "contaminated")
    side = F.broadcast(bad) if bad.count() <= BROADCAST_HASHES else bad.hint("merge")
    return docs.join(side, F.xxhash64(docs["text"]) == F.col("_velograph_bad"), "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that meet; nulls, repeats and ids as ``contaminated`` says."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = rf"""
WITH d AS (
  SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM (
    SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '([{UNSPACED}])', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS t FROM documents)),
items AS (
  SELECT item_id, t, len(t) AS n FROM (
    SELECT item_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '([{UNSPACED}])', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '') AS t FROM benchmark)),
b AS (
  SELECT item_id, n, unnest(t) AS tok, generate_subscripts(t, 1) AS pos FROM items),
lined AS (
  SELECT doc_id, item_id, n, d.pos - b.pos AS diag, b.pos AS p FROM d JOIN b USING (tok)),
counted AS (
  SELECT doc_id, item_id, n, count(*) OVER (PARTITION BY doc_id, item_id, diag ORDER BY p RANGE BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS c FROM lined)
SELECT doc_id, item_id, CAST(max(c) AS INTEGER) AS matched, CAST(least(n, {WINDOW}) AS INTEGER) AS "window" FROM counted
WHERE c >= least(n, {WINDOW}) - CASE WHEN n >= {WINDOW} THEN {SUBSTITUTED} WHEN n >= {SEEDED} THEN 1 ELSE 0 END GROUP BY doc_id, item_id, n
"""
