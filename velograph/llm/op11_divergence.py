"""How far the sources of a language diverge in the words they use, pair by pair, with tiles of blocks of groups.

Documents are grouped by (lang, source).  A language keeps the terms that enough of its documents have, and every group
gives each of them a smoothed share in billionths.  The terms of a language are dealt into chunks, and a group's counts
in a chunk are packed into one row: the places of its terms there, and their counts.

Pairs are worked out as a matrix of group blocks by group blocks.  A packed row goes to each tile that its block is in,
one for each block of its language, and not to each pair.  A tile reads its rows in order of chunks and adds, chunk by
chunk, the differences of all pairs of its two blocks; it holds one chunk of two blocks at a time, however many terms
there are.  Long vocabularies are cut into stripes of chunks as well, whose sums are added, so that a language with few
sources and many terms is more than one task.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velograph.llm.streamed import dealt, groups
from velograph.llm.tables import table
from velograph.operators.joins import join_by_share
from velograph.plans.materialize import materialize

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS = 30
TOP = 50
PRIOR = 5
#: Shares are in units of one over this.
UNIT = 1_000_000_000
#: Terms a chunk, groups a block and chunks a stripe, on average as terms and groups are dealt by a hash.
CHUNK, BLOCK, STRIPE = 4_096, 32, 64


def counted_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of whole texts; the empty term has the documents of the group.

    A batch's words are one Arrow array of codes; its counts come from sorting those, and go on as a row for each group
    and term of the batch.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def counts(batch: pa.RecordBatch) -> pa.RecordBatch:
        group_of = batch.select(["lang", "source"]).to_pandas().groupby(["lang", "source"], sort=False).ngroup().to_numpy()
        _, one = np.unique(group_of, return_index=True)
        # only A-Z are lowered; what is between terms is the rest of ASCII, and leaves empty words at the ends
        words = pc.split_pattern_regex(pc.ascii_lower(batch["text"]), BETWEEN)
        doc = np.repeat(np.arange(len(words)), np.diff(words.offsets.to_numpy()))
        coded = words.flatten().dictionary_encode()
        code, v = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
        if (empty := pc.index(coded.dictionary, "").as_py()) >= 0:
            doc, code = doc[code != empty], code[code != empty]
        in_doc, n = np.unique(doc * v + code, return_counts=True)
        key = group_of[in_doc // max(v, 1)] * v + in_doc % max(v, 1)
        order = np.argsort(key, kind="stable")
        key, starts = np.unique(key[order], return_index=True)
        n = np.add.reduceat(n[order], starts) if len(starts) else n
        of = np.concatenate([one[key // max(v, 1)], one])
        terms = pa.concat_arrays([coded.dictionary.take(pa.array(key % max(v, 1))), pa.array([""] * len(one), coded.dictionary.type)])
        docs_ = np.concatenate([np.diff(starts, append=len(order)), np.bincount(group_of, minlength=len(one))])
        at = pa.array(of)
        return pa.RecordBatch.from_arrays([batch["lang"].take(at), batch["source"].take(at), terms, pa.array(np.concatenate([n, docs_[len(n) :]]), pa.int64()), pa.array(docs_, pa.int64())], ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield counts(batch)

    parts = docs.select(name("lang"), name("source"), name("text")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, prior: int = PRIOR) -> Column:
    """1 + floor(UNIT * (n + prior) / total), exactly."""
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (n + prior).cast("decimal(18,0)"), total.cast("decimal(18,0)"))


def shares(counts: np.ndarray, totals: np.ndarray, prior: int = PRIOR) -> np.ndarray:
    """``share`` of a row of counts a group, three digits at a time so that no product leaves 64 bits."""
    rest = counts + prior
    total = totals[:, None]
    whole, rest = np.divmod(rest, total)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + more
    return whole + 1


def _tile(same: bool, pieces: Iterator[pd.DataFrame], prior: int) -> Iterator[tuple[str, str, int]]:
    """(source, other, sum of differences) of the pairs of one tile, of a block with itself or with another; rows come by
    chunk, the groups' names before all."""
    heads: list[pd.DataFrame] = []
    sums = place = lengths = totals = waiting = None
    side = []
    at = 0

    def begin() -> None:
        nonlocal sums, place, lengths, totals, side
        names = pd.concat(heads)
        place = {(s, g): i for i, (s, g) in enumerate(zip(names["side"], names["g"], strict=True))}
        totals = names["total"].to_numpy(np.int64)
        lengths = names["lengths"].iloc[0]
        one = np.flatnonzero(names["side"].to_numpy() == 0)
        two = np.flatnonzero(names["side"].to_numpy() == 1)
        side = [one, one if same else two]
        sums = np.zeros((len(side[0]), len(side[1])), np.int64)

    def add(rows: list[pd.DataFrame], length: int) -> None:
        counts = np.zeros((len(totals), length), np.int64)
        for part in rows:
            for s, g, places, n in zip(part["side"], part["g"], part["places"], part["counts"], strict=True):
                counts[place[s, g], np.asarray(places)] = np.asarray(n)
        p = shares(counts, totals, prior).astype(np.int32)
        other = p[side[1]]
        for i, own in enumerate(side[0]):
            sums[i] += np.abs(other - p[own]).sum(axis=1, dtype=np.int64)

    def until(chunk: int) -> None:
        """Add the chunks before ``chunk``, those included that none of these groups has a term of."""
        nonlocal at, waiting
        while at < chunk:
            add(waiting or [], int(lengths[at]))
            waiting, at = None, at + 1

    for piece in pieces:
        chunks = piece["at"].to_numpy()
        if (chunks < 0).any():
            heads.append(piece[chunks < 0])
        for chunk in np.unique(chunks[chunks >= 0]).tolist():
            if sums is None:
                begin()
            until(chunk)
            waiting = [*(waiting or []), piece[chunks == chunk]]
    if sums is None:
        begin()
    until(len(lengths))
    names = pd.concat(heads)["source"].tolist()
    for i, a in enumerate(side[0]):
        for j, b in enumerate(side[1]):
            if not same or i < j:
                yield names[a], names[b], int(sums[i, j])


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, prior: int = PRIOR, chunk: int = CHUNK, block: int = BLOCK, stripe: int = STRIPE) -> DataFrame:
    """(lang, source, part, item, value, rank) of the groups of ``docs`` (text, lang, source; other columns are ignored).

    Part ``pair`` has a row for each other source of the language, with the summed difference of the shares of all kept
    terms; part ``term`` the ``top`` terms that a group has and uses more than its language.  Ties go to the smaller item
    in UTF-8.  Nulls count as the empty string, in texts as in names, and each row is a document, repeated or not.  A
    group without terms is a group, with no counts; in a language that keeps no term all pairs are 0 apart and there is
    no part ``term``.  The only source of a language has no pairs.  An empty table gives an empty result.
    """
    counted = materialize(counted_terms(docs), "counted")
    there, uses = counted.where("term = ''").select("lang", "source"), counted.where("term <> ''")
    kept = uses.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("uses"), F.count("*").alias("users"))
    kept = materialize(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept")
    langs = there.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("uses").alias("all_uses")), "lang", "left")
    langs = langs.select("lang", "sources", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("all_uses", F.lit(0)).alias("all_uses"))
    langs = langs.withColumns({"blocks": F.ceil(F.col("sources") / block).cast("int"), "chunks": F.ceil(F.col("terms") / chunk).cast("int"), "lang_total": F.col("all_uses") + prior * F.col("terms"), "prior": prior * F.col("terms")})
    langs = materialize(langs, "langs")

    numbered = join_by_share(kept, langs.select("lang", "terms", "chunks"), ["lang"], "terms", kept.count())
    numbered = numbered.withColumn("chunk", F.pmod(F.xxhash64("term"), F.col("chunks")).cast("int"))
    numbered = materialize(numbered.withColumn("place", F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1).drop("chunks"), "numbered")
    cells = materialize(join_by_share(uses.drop("docs"), numbered, ["lang", "term"], "users", uses.count()), "cells")

    own = cells.groupBy("lang", "source").agg(F.sum("n").alias("own_uses"), F.count("*").alias("own_terms"))
    named = join_by_share(there, langs, ["lang"], "sources", there.count()).join(own, ["lang", "source"], "left")
    named = named.withColumns({"own_terms": F.coalesce("own_terms", F.lit(0)), "total": F.coalesce("own_uses", F.lit(0)) + F.col("prior"), "block": F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")})
    named = materialize(named.withColumn("g", F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1).drop("own_uses", "all_uses", "prior"), "groups")

    p, q = share(F.col("n"), F.col("total"), prior), share(F.col("uses"), F.col("lang_total"), prior)
    used = join_by_share(cells, named.select("lang", "source", "total", "lang_total", "own_terms"), ["lang", "source"], "own_terms", cells.count())
    more = used.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    best = ranked(more).where(F.col("rank") <= top)

    lengths = numbered.groupBy("lang", "chunk").agg(F.count("*").cast("int").alias("length"))
    every = langs.select("lang", F.explode(F.sequence(F.lit(0), F.greatest("chunks", F.lit(1)) - 1)).alias("chunk")).join(lengths, ["lang", "chunk"], "left")
    every = every.groupBy("lang", F.floor(F.col("chunk") / stripe).cast("int").alias("stripe")).agg(F.array_sort(F.collect_list(F.struct("chunk", F.coalesce("length", F.lit(0)).alias("length")))).alias("x"))
    every = every.select("lang", "stripe", F.col("x.length").alias("lengths"))
    placed = named.select("lang", "source", "block", "blocks", "g", "total")
    heads = placed.join(every, "lang").select("*", F.lit(-1).alias("at"), F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<long>").alias("counts"))
    packed = cells.groupBy("lang", "source", "chunk").agg(F.collect_list(F.struct("place", "n")).alias("x"))
    packed = packed.select("lang", "source", F.floor(F.col("chunk") / stripe).cast("int").alias("stripe"), (F.col("chunk") % stripe).alias("at"), F.col("x.place").alias("places"), F.col("x.n").alias("counts"))
    vectors = placed.join(packed, ["lang", "source"]).withColumn("lengths", F.lit(None).cast("array<int>"))
    tiled = heads.unionByName(vectors).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    name = F.when(F.col("at") < 0, F.col("source"))
    tiled = tiled.select("lang", "stripe", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "at", (F.col("block") > F.col("other")).cast("int").alias("side"), "g", name.alias("source"), "total", "lengths", "places", "counts")
    keys = ["lang", "stripe", "one", "two"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for key, pieces in groups(batches, keys):
            found = [(key[0], *row) for row in _tile(key[2] == key[3], pieces, prior)]
            yield pd.DataFrame(found, columns=["lang", "source", "item", "value"]).astype({"value": "int64"})

    sums = dealt(tiled, keys, ["at", "side", "g"]).mapInPandas(run, "lang string, source string, item string, value long")
    both = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = both.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e"), "value").select("lang", "e.*", "value")
    out = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return out(ranked(both), "pair").union(out(best, "term"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of sources and the fifty terms of each; nulls, ties, repeats and groups without terms as ``divergence`` says."""
    return divergence(table(spark, sf_dir, "documents"))


OP11_SQL = rf"""
WITH words AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{TERM}') AS terms FROM documents),
there AS (SELECT DISTINCT lang, source FROM words),
kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM words) GROUP BY lang, term HAVING count(*) >= {LEAST_DOCS}),
uses AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM words) GROUP BY ALL),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cells AS (
  SELECT there.lang, there.source, kept.term, coalesce(uses.n, 0) AS n
  FROM there JOIN kept ON there.lang = kept.lang LEFT JOIN uses ON uses.lang = there.lang AND uses.source = there.source AND uses.term = kept.term),
own AS (
  SELECT lang, source, term, n, 1 + (CAST({UNIT} AS HUGEINT) * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY lang, source) + {PRIOR} * v) AS p
  FROM cells JOIN sizes USING (lang)),
whole AS (
  SELECT lang, term, 1 + (CAST({UNIT} AS HUGEINT) * (n + {PRIOR})) // (sum(n) OVER (PARTITION BY lang) + {PRIOR} * v) AS q
  FROM (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY lang, term) JOIN sizes USING (lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM there a JOIN there b ON a.lang = b.lang AND a.source <> b.source),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM own a JOIN own b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN apart USING (lang, source, item)
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item COLLATE "BINARY") AS rank FROM ranked)
WHERE part = 'pair' OR rank <= {TOP}
"""
