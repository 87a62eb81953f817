"""Windows whose content starts anywhere else: the part that byte and word deduplication share.

1. Every text is cut into runs of windows by content-chosen anchors (``winnow_kernel``).  Equal windows have equal
   anchors, so a run whose anchor occurs nowhere else holds no repeat and is done with.
2. Runs of equal content are grouped by anchor and a 64-bit hash of the content, map-side first: exact copies of any
   number become one row.  Two contents are confused only if 64 bits agree by chance among the contents of one anchor.
3. Anchors shared by *different* contents are left.  One occurrence of each content is read from the texts again and
   handed, in shards of whole anchors, to the operator's own search.
4. An anchor with more contents than a shard should hold is made longer (``_longer``): its windows are parted by how
   far before the anchor they start, into a nearer and a farther half, and the symbols that all windows of a half
   contain, known to be equal in equal windows, are the key in place of the anchor.  Equal contents of a key become
   one again.  Keys that are still too common are halved again; the last halves are single windows, where a key is
   the whole window and has one content.  So every key is at last small enough for a shard, and none is cut.

A document is known by its doc_id and a hash of its text, so repeated ids, null ids and repeated rows are all sound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velograph.llm.winnow_kernel import BLOCK, gram_hashes, runs_of
from velograph.operators.joins import HEAVY, SHUFFLED, join_by_share
from velograph.plans.materialize import materialize, release


class Unit(NamedTuple):
    """What a symbol is: ``encode`` gives a text's symbols as bytes of ``itemsize`` each, ``hashes`` mixes them."""

    window: int
    k: int
    itemsize: int
    encode: Callable[[str | None], bytes]
    hashes: Callable[[bytes], np.ndarray]


#: (contents, anchors) to, for each content, a mask of its window starts whose window also starts elsewhere in them.
Search = Callable[[list[bytes], np.ndarray], list[np.ndarray]]

RUNS = "d long, h long, m long, c long, p int, n int"
SPANS = "d long, h long, s int, e int"
#: Contents of a key that go to one shard; a key of more is made longer first.
KEY_CONTENTS = 2_000
#: Contents that one shard aims at.
SHARD_CONTENTS = 6_000
PIECES = "d long, h long, m long, copies long, p int, content binary"
HALVES = PIECES + ", key long, c long, low int, high int, place int"


def _blocks(keys: list[tuple], texts: list[str | None], unit: Unit) -> Iterator[tuple[list[tuple[int, int]], bytes, np.ndarray]]:
    """Documents laid end to end up to BLOCK symbols: ([(row, offset of its first symbol)], symbols, lengths)."""
    held: list[tuple[int, int]] = []
    parts: list[bytes] = []
    total = 0

    def out():
        return held, b"".join(parts), np.array([len(x) // unit.itemsize for x in parts], np.int64)

    for row in range(len(keys)):
        symbols = unit.encode(texts[row])
        length = len(symbols) // unit.itemsize
        for at in range(0, max(1, length - unit.window + 1), BLOCK // 2):
            piece = symbols[at * unit.itemsize : (at + BLOCK // 2 + unit.window - 1) * unit.itemsize]
            if len(piece) < unit.window * unit.itemsize:
                continue
            if total + len(piece) // unit.itemsize > BLOCK:
                yield out()
                held, parts, total = [], [], 0
            held.append((row, at))
            parts.append(piece)
            total += len(piece) // unit.itemsize
    if held:
        yield out()


def keyed(docs: DataFrame, *carried: Column) -> DataFrame:
    """(d, h, text) of (doc_id, text), and what is carried along."""
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), "text", *carried)


def _runs(src: DataFrame, unit: Unit) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d, h, texts = batch["d"].astype("Int64"), batch["h"].to_numpy(), batch["text"].tolist()
            for held, symbols, lengths in _blocks(h, texts, unit):
                found = runs_of(unit.hashes(symbols), lengths, unit.window, unit.k)
                row, offset = np.array(held).T
                base = np.cumsum(lengths) - lengths
                size = unit.itemsize
                begins = (found.first * size).tolist()
                ends = ((found.first + found.count + unit.window - 1) * size).tolist()
                hashes = np.array([xxhash.xxh3_64_intdigest(symbols[b:e]) for b, e in zip(begins, ends, strict=True)], np.uint64).view(np.int64)
                rows = row[found.doc]
                yield pd.DataFrame({"d": d.iloc[rows].array, "h": h[rows], "m": found.anchor, "c": hashes, "p": (found.first - base[found.doc] + offset[found.doc]).astype("int32"), "n": found.count.astype("int32")})

    return src.mapInPandas(run, RUNS)


def _ranges(mask: np.ndarray, at: int, window: int) -> Iterator[tuple[int, int]]:
    """Spans of symbols that the windows starting at ``at`` plus the set places of ``mask`` cover; they may touch."""
    edges = np.flatnonzero(np.diff(np.r_[0, mask.astype(np.int8), 0]))
    for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield at + b, at + e - 1 + window


def _longer(unit: Unit) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Turns rows of HALVES, whose windows start ``low`` to ``high`` symbols before the anchor at ``place`` in the
    content, into those of the two halves of that range.  Rows of PIECES are rows of the whole range."""
    window, k, size = unit.window, unit.k, unit.itemsize

    def place_of(content: bytes, anchor: int) -> int:
        """The last place of the anchor that is in every window of the content, as the anchor was chosen."""
        grams = gram_hashes(unit.hashes(content), k)
        hits = np.flatnonzero(grams.view(np.int64) == anchor)
        return int(hits[(hits >= len(content) // size - window) & (hits <= window - k)][-1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            first = "low" not in batch.columns
            for row in batch.assign(d=batch["d"].astype("Int64")).to_dict("records"):
                content = row["content"]
                low, high, place = (0, window - k, place_of(content, row["m"])) if first else (row["low"], row["high"], row["place"])
                middle = (low + high + 1) // 2
                for a, b in ((low, middle - 1), (middle, high)):
                    begin, end = max(0, place - b), min(len(content) // size - window, place - a)
                    if a > b or begin > end:
                        continue
                    shared = content[(place - a) * size : (place + window - b) * size]
                    part = content[begin * size : (end + window) * size]
                    key, c = (xxhash.xxh3_64_intdigest(x, a) for x in (shared, part))
                    out.append((row["d"], row["h"], row["m"], row["copies"], row["p"] + begin, part, key, c, a, b, place - begin))
            found = pd.DataFrame(out, columns=[x.split()[0] for x in HALVES.split(", ")])
            yield found.assign(d=found["d"].astype("Int64"), **{x: found[x].astype("uint64").astype("int64") for x in ("key", "c")})

    return run


def repeated_spans(src: DataFrame, unit: Unit, search: Search, *, key_contents: int = KEY_CONTENTS) -> DataFrame:
    """(d, h, s, e): spans of symbols of the keyed documents ``src`` that windows starting elsewhere too cover."""
    window, size = unit.window, unit.itemsize
    src = src.select("d", "h", "text")
    runs = materialize(_runs(src, unit), "runs")
    total = runs.count()
    heavy = [r["m"] for r in runs.groupBy("m").agg(F.count("*").alias("_n")).where(F.col("_n") > total / HEAVY).select("m").collect()]
    # dealt by anchor once: how often an anchor, a content and its kinds occur needs no further shuffle then
    of = Window.partitionBy
    dealt = runs.where(~F.col("m").isin(heavy)) if heavy else runs
    dealt = dealt.repartition("m").withColumn("_n", F.count("*").over(of("m"))).where("_n > 1")
    dealt = dealt.withColumns({"copies": F.count("*").over(of("m", "c")), "first": F.row_number().over(of("m", "c").orderBy("d", "h", "p")) == 1})
    dealt = dealt.withColumn("v", F.sum(F.col("first").cast("long")).over(of("m"))).where("copies > 1 or v > 1")
    live = materialize(dealt.select("d", "h", "m", "p", "n", "copies", "first", "v"), "runs-shared")
    copied, pieces = live.where("copies > 1"), live.where("first and v > 1").select("m", "copies", "v", "d", "h", "p", "n")
    if heavy:
        # an anchor with a large share of the runs is dealt by content, and a content with a large share is one row
        hot, name = runs.where(F.col("m").isin(heavy)), F.xxhash64("m", "c")
        kinds = hot.groupBy("m", "c").agg(F.count("*").alias("copies"), F.min(F.struct("d", "h", "p", "n")).alias("one")).where(F.col("copies") > total / HEAVY)
        kinds = materialize(kinds.withColumn("name", name), "contents")
        names = [r["name"] for r in kinds.select("name").collect()]
        rest = hot.where(~name.isin(names)).repartition("m", "c")
        rest = materialize(rest.withColumns({"copies": F.count("*").over(of("m", "c")), "first": F.row_number().over(of("m", "c").orderBy("d", "h", "p")) == 1}), "runs-hot")
        copied = copied.select("d", "h", "p", "n").union(rest.where("copies > 1").select("d", "h", "p", "n")).union(hot.where(name.isin(names)).select("d", "h", "p", "n"))
        ones = rest.where("first").select("m", "copies", "d", "h", "p", "n").union(kinds.select("m", "copies", "one.*"))
        variants = ones.groupBy("m").agg(F.count("*").alias("v")).where("v > 1")  # at most HEAVY anchors
        pieces = pieces.unionByName(ones.join(F.broadcast(variants), "m"))
    spans = [copied.select("d", "h", F.col("p").alias("s"), (F.col("p") + F.col("n") + (window - 1)).alias("e"))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, contents = [], []
            for row, (text, first, count) in enumerate(zip(batch["text"], batch["p"], batch["n"], strict=True)):
                symbols = unit.encode(text)
                contents += [symbols[b : b + n] for b, n in zip((first * size).tolist(), ((count + (window - 1)) * size).tolist(), strict=True)]
                rows.append(np.full(len(first), row))
            at = np.concatenate(rows) if rows else np.empty(0, np.int64)
            flat = {c: np.concatenate(batch[c].tolist()) if len(batch) else [] for c in ("m", "copies", "v", "p")}
            yield pd.DataFrame({"d": batch["d"].astype("Int64").iloc[at].array, "h": batch["h"].to_numpy()[at], **flat, "content": contents})

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        # repeated rows of a document give the same pieces again, and a piece is wanted once
        group = group.drop_duplicates(["m", "p", "d", "h"]).sort_values(["m", "p", "h"], kind="stable")
        masks = search(group["content"].tolist(), group["m"].to_numpy())
        out = [(d, h, s, e) for d, h, p, copies, mask in zip(group["d"].astype("Int64"), group["h"], group["p"], group["copies"], masks, strict=True) if copies == 1 for s, e in _ranges(mask, p, window)]
        return pd.DataFrame(out, columns=["d", "h", "s", "e"]).astype({"d": "Int64"})

    wanted = pieces.groupBy("d", "h").agg(F.collect_list(F.struct("m", "copies", "v", "p", "n")).alias("want"))
    found = src.withColumnsRenamed({"d": "_d", "h": "_h"}).join(wanted.hint(SHUFFLED), F.col("_d").eqNullSafe(F.col("d")) & F.col("_h").eqNullSafe(F.col("h")))
    texts = found.select("d", "h", "text", *[f"want.{c}" for c in ("m", "copies", "v", "p", "n")]).mapInPandas(read, "d long, h long, m long, copies long, v long, p int, content binary")
    columns = [x.split()[0] for x in PIECES.split(", ")]
    texts = materialize(texts, "pieces")
    if not heavy:
        release(runs)
    count, most = texts.agg(F.count("*"), F.max("v")).first()
    ready = [texts.where(F.col("v") <= key_contents).select(*columns, F.col("m").alias("key"))]
    many = texts.where(F.col("v") > key_contents).select(*columns).dropDuplicates(["d", "h", "m", "p"])
    while (most or 0) > key_contents:
        halves = materialize(many.mapInPandas(_longer(unit), HALVES), "halves")
        one = F.min(F.struct(*columns, "low", "high", "place")).alias("one")
        again = materialize(halves.groupBy("key", "c").agg(F.count("*").alias("n"), one), "halves-contents")
        twice = join_by_share(halves.where("copies = 1"), again.where("n > 1").select("key", "c", "n"), ["key", "c"], "n", halves.count(), "left_semi")
        spans.append(twice.select("d", "h", F.col("p").alias("s"), (F.col("p") + F.length("content") / size).cast("int").alias("e")))
        # what stands for several contents is covered above and only compared with the others from here on
        kept = again.select("key", *[F.when(F.col("n") > 1, F.lit(2).cast("long")).otherwise(F.col("one.copies")).alias(x) if x == "copies" else F.col(f"one.{x}").alias(x) for x in (*columns, "low", "high", "place")])
        v = materialize(kept.groupBy("key").agg(F.count("*").alias("v")).where("v > 1"), "halves-variants")
        most = v.agg(F.max("v")).first()[0]
        met = materialize(join_by_share(kept, v.withColumn("_n", F.col("v")), ["key"], "_n", again.count()), "halves-left")
        ready.append(met.where(F.col("v") <= key_contents).select(*columns, "key"))
        many = met.where(F.col("v") > key_contents).select(*columns, "low", "high", "place")
    shards = max(1, -(-(count or 0) // SHARD_CONTENTS))
    dealt = reduce(DataFrame.union, ready).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))
    spans.append(dealt.groupBy("shard").applyInPandas(compare, SPANS))
    return reduce(DataFrame.union, spans)


def with_spans(src: DataFrame, spans: DataFrame) -> DataFrame:
    """``src`` with begins and ends of its spans, null where it has none; one shuffle of the documents."""
    own = spans.distinct().groupBy(F.col("d").alias("_d"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("s", "e")).alias("_spans"))
    met = src.join(own.hint(SHUFFLED), F.col("d").eqNullSafe(F.col("_d")) & F.col("h").eqNullSafe(F.col("_h")), "left")
    return met.select(*src.columns, F.col("_spans.s").alias("begins"), F.col("_spans.e").alias("ends"))


def covered(begins, ends, length: int) -> np.ndarray:
    """A mask of the symbols that spans cover."""
    edges = np.zeros(length + 1, np.int64)
    if begins is not None:
        np.add.at(edges, np.asarray(begins), 1)
        np.add.at(edges, np.asarray(ends), -1)
    return np.cumsum(edges[:-1]) > 0
