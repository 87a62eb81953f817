"""Near-copies of texts for the pipeline: pairs whose sets of word shingles have a Jaccard similarity of at least 0.8.

Operator 5 comes first: SimHash fingerprints of the five-word shingles are linked by covering hashing.  Fingerprints of
texts at a similarity of 0.8 differ in about 9.7 bits with a deviation of 2.9, so its radius of 4 finds the closer
copies only, and a radius that holds them all needs more than 2 ** 17 tables.  What it leaves is found with MinHash
bands, ``BANDS`` keys of ``ROWS`` minima each: a pair of similarity J shares a key with probability
1 - (1 - J ** 5) ** 32, which is 0.999997 at 0.8 and more above.  Every candidate of either kind is verified on the whole
sets, so no looser pair is linked.

Equal sets are one node.  The links of operator 5 are a forest, so they are about a pair a node.  Of a bucket of bands, a
pivot is compared with all others.  Of the buckets that are not one component after that, small ones give their pairs; large ones are dealt into parts, and each two parts of a
bucket are compared in one task, in memory.  No bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velograph.llm.op05_simhash import fingerprint_links, one_of_each
from velograph.llm.simhash_kernel import SEED, majority_bits, shingle_hashes
from velograph.operators.components import connected_components
from velograph.operators.joins import SHUFFLED, join_by_share
from velograph.plans.materialize import materialize, release

WIDTH = 5
BANDS, ROWS = 32, 5
#: Shingles whose minima are taken at once.
BLOCK = 1 << 12
#: Shingles and nodes of a part of a large bucket, about.
PART_SHINGLES, PART_NODES = 1 << 20, 4_096

_RNG = np.random.default_rng(SEED)
_XOR, _ODD = (_RNG.integers(0, 2**64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
_ODD |= np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    return np.unique(shingle_hashes(text, width))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A signed key for each band; no keys for an empty set."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        np.minimum(least, ((shingles[None, at : at + BLOCK] ^ _XOR) * _ODD).min(axis=1), out=least)
    octets = least.astype("<u8").tobytes()
    size = ROWS * 8
    return np.array([xxhash.xxh64_intdigest(octets[b * size : (b + 1) * size], b) for b in range(BANDS)], np.uint64).view(np.int64)


def _described(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, h, s, n, fp, bands): hashes of the text and of its set of shingles, the set's size, fingerprint and band keys."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            every = [shingle_hashes(t, width) for t in batch["text"]]
            prints = np.array([majority_bits(x) for x in every], np.uint64).view(np.int64)
            sets = [np.unique(x) for x in every]
            names = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "h": batch["h"], "s": names, "n": [len(x) for x in sets], "fp": prints, "bands": [band_keys(x) for x in sets]})

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInPandas(run, "doc_id long, h long, s long, n long, fp long, bands array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(s, n, shingles) of ``nodes`` (s, one), from the text of the one row that stands for each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch["text"]]
            yield pd.DataFrame({"s": batch["s"], "n": [len(x) for x in sets], "shingles": [x.view(np.int64) for x in sets]})

    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), "text")
    # grouped by h too, as the join has dealt the rows by it
    met = texts.join(nodes.select("s", "one.*").hint(SHUFFLED), ["h"]).where(F.col("d").eqNullSafe(F.col("doc_id"))).groupBy("h", "s").agg(F.first("text").alias("text"))
    return met.select("s", "text").mapInPandas(run, "s long, n long, shingles array<long>")


def _close(n: Column, m: Column) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return F.least(n, m) * 5 >= F.greatest(n, m) * 4


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) with a Jaccard similarity of at least 0.8."""
    left = sets.select(F.col("s").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("s").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("xb"))
    common = F.size(F.array_intersect("xa", "xb"))
    return pairs.distinct().join(left.hint(SHUFFLED), "a").join(right.hint(SHUFFLED), "b").where(common * 9 >= (F.col("na") + F.col("nb")) * 4).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    """``pairs`` (x, y) of different nodes as (a, b), the smaller one first."""
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """(a, b): candidates of operator 5: nodes of equal fingerprints and a forest of the links between fingerprints."""
    first = nodes.groupBy("fp").agg(F.min("s").alias("x"))
    same = nodes.join(first.hint(SHUFFLED), "fp").select("x", F.col("s").alias("y"))
    links = fingerprint_links(first.select("fp"))
    name = lambda end, as_: first.select(F.col("fp").alias(end), F.col("x").alias(as_))
    return _ordered(same.union(links.join(name("a", "x").hint(SHUFFLED), "a").join(name("b", "y").hint(SHUFFLED), "b").select("x", "y")))


def _small_pairs(members: DataFrame) -> DataFrame:
    """(a, b): the pairs of each row's ``members`` (s, n, c) that have close sizes and are not of one component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {(a["s"], b["s"]) for m in batch["members"] for a, b in combinations(sorted(m, key=lambda x: x["s"]), 2) if a["c"] != b["c"] and 5 * min(a["n"], b["n"]) >= 4 * max(a["n"], b["n"])}
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return members.mapInPandas(run, "a long, b long")


def _forest(names: np.ndarray, shingles: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of all links between the sets."""
    sizes = np.array([len(x) for x in shingles], np.int64)
    _, flat = np.unique(np.concatenate(shingles), return_inverse=True)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    marked, open_, found = np.zeros(flat.max() + 1, np.int64), np.ones(len(names), bool), []
    for start in range(len(names)):
        stack = [start] if open_[start] else []
        open_[start] = False
        while stack:
            at = stack.pop()
            own = flat[begins[at] : begins[at] + sizes[at]]
            marked[own] = 1
            common = np.add.reduceat(marked[flat], begins)
            marked[own] = 0
            near = np.flatnonzero(open_ & (common * 9 >= (sizes + sizes[at]) * 4))
            open_[near] = False
            stack += near.tolist()
            found += [(int(names[at]), int(names[i])) for i in near]
    return found


def _whole(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links whose components are those of all pairs in each bucket of ``rest`` (key, s, parts)."""
    own = F.pmod(F.xxhash64(F.lit("part"), "s"), F.col("parts")).cast("int")
    dealt = rest.select("key", "s", own.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    placed = dealt.select("key", "s", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")).join(sets.select("s", "shingles").hint(SHUFFLED), "s")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_forest(group["s"].to_numpy(), group["shingles"].tolist()), columns=["a", "b"], dtype="int64")

    return placed.groupBy("key", "i", "j").applyInPandas(run, "a long, b long")


def _components(docs: DataFrame, nodes: DataFrame, width: int, bucket_limit: int) -> DataFrame:
    """(node, component) of the nodes that have a link."""
    near = materialize(_by_fingerprint(nodes), "near-prints")
    rows = nodes.select("s", "n", F.explode("bands").alias("key"))
    counts = materialize(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "counts")
    held = materialize(join_by_share(rows, counts.withColumn("rows", F.col("size")), ["key"], "rows", nodes.count() * BANDS), "held")
    pivot = F.min(F.struct(F.xxhash64(F.lit("pivot"), "s").alias("o"), F.col("s").alias("p"), F.col("n").alias("np"))).alias("one")
    pivots = materialize(held.groupBy("key").agg(F.first("size").alias("rows"), pivot).select("key", "rows", "one.p", "one.np"), "pivots")
    # a row a node, so that its component is found once and not once a bucket
    met = join_by_share(held, pivots, ["key"], "rows", held.count()).groupBy("s").agg(F.first("n").alias("n"), F.collect_list(F.struct("key", "size", "p", "np")).alias("buckets"))
    met = materialize(met, "buckets")
    release(counts, held, pivots)
    some = met.select("s").union(near.select("a")).union(near.select("b")).distinct()
    sets = materialize(_sets(docs, nodes.join(some.hint(SHUFFLED), "s", "left_semi"), width), "shingles")
    links = materialize(_verified(near, sets), "links")
    stars = met.select(F.col("s").alias("x"), "n", F.explode(F.array_distinct(F.transform("buckets", lambda b: F.struct(b["p"].alias("y"), b["np"].alias("m"))))).alias("b")).select("x", "n", "b.*")
    stars = _ordered(stars.where(_close(F.col("n"), F.col("m")))).distinct().join(links.hint(SHUFFLED), ["a", "b"], "left_anti")
    links = materialize(links.union(_verified(stars, sets)), "links")
    parts = connected_components(links)
    every = met.join(parts.hint(SHUFFLED), F.col("s") == F.col("node"), "left").select("s", "n", F.coalesce("component", "s").alias("c"), F.explode("buckets").alias("b")).select("s", "n", "c", "b.*")
    open_ = every.where("size > 2").groupBy("key").agg(F.count("*").alias("m"), F.sum("n").alias("total"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    open_ = materialize(open_.select("key", F.ceil(F.greatest(F.col("m") / PART_NODES, F.col("total") / PART_SHINGLES)).cast("int").alias("parts")), "open")
    if open_.isEmpty():
        return parts
    rest = materialize(every.join(open_.hint(SHUFFLED), "key"), "left")
    small = rest.where(F.col("size") <= bucket_limit).groupBy("key").agg(F.collect_list(F.struct("s", "n", "c")).alias("members")).select("members")
    more = _verified(_small_pairs(small), sets).union(_whole(rest.where(F.col("size") > bucket_limit), sets))
    return connected_components(links.union(more))


def drop_near_copies(docs: DataFrame, width: int = WIDTH, bucket_limit: int = 64) -> DataFrame:
    """One row of ``docs`` for each component of near-copies, all columns kept: that of the smallest doc_id, null ids last.

    Texts of fewer than ``width`` words are one shingle, and texts without words are copies of each other.  Rows with
    null or repeated ids are known by their text too, and of rows equal in both one stays.  Texts count whole, however
    long.  An empty table gives an empty result.
    """
    own = materialize(_described(docs, width), "described")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    nodes = materialize(own.groupBy("s").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), one.alias("one")), "nodes")
    repeated = own.groupBy("doc_id", "h").agg(F.count("*").alias("rows")).where("rows > 1")
    parts = _components(docs, nodes, width, bucket_limit)
    root = nodes.select("s", "one").join(parts.hint(SHUFFLED), F.col("s") == F.col("node"), "left").select("one", F.coalesce("component", "s").alias("root"))
    return one_of_each(docs, root, repeated)
