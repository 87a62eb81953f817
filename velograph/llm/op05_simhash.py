"""SimHash near-duplicate detection with covering locality-sensitive hashing.

Every text gets a 64-bit SimHash.  Distinct fingerprints are then put into ``2**(radius + 1) - 1`` tables, each of
which looks at the bits of one structured mask.  Bit i of a fingerprint has a code phi(i) of ``radius + 1`` bits, and
the mask of table v holds the bits whose code has an odd inner product with v.  For fingerprints that differ in at
most ``radius`` bits there are at most ``radius`` linear equations <phi(i), v> = 0 over ``radius + 1`` unknowns, so
some v other than zero satisfies them all: that table's mask covers no differing bit and the two collide there.  No
pair within the radius is missed, whatever the data.

Exact copies share a fingerprint, so they are grouped before any table is built.  Buckets up to ``bucket_limit``
fingerprints are compared inside one row of a table.  Larger ones are linked exactly through midpoints: fingerprints
within 2m bits of each other have a common neighbour within m bits of both, and two fingerprints with a common
neighbour within m bits are within 2m bits.  Grouping by neighbour therefore gives the same components with a fixed
number of rows for each fingerprint, however large the bucket, instead of a number that grows with its square.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm.simhash_kernel import fingerprints
from velograph.llm.tables import table
from velograph.operators.components import connected_components
from velograph.operators.joins import SHUFFLED, join_by_share
from velograph.plans.materialize import materialize

BITS = 64


def covering_masks(radius: int) -> list[int]:
    """The bits each table looks at; every set of at most ``radius`` bits is disjoint from some mask."""
    codes = (1 << (radius + 1)) - 1
    code = [i % codes + 1 for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (code[i] & v).bit_count() & 1) for v in range(1, codes + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def with_fingerprint(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, h, fp): a hash of the whole text, and its SimHash, both as signed longs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "h": batch["h"], "fp": fingerprints(batch["text"], width)})

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInPandas(run, "doc_id long, h long, fp long")


def _linked(members: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links between the fingerprints of one bucket, grown from its smallest members."""
    values = np.sort(members.view(np.uint64))
    open_ = np.ones(len(values), bool)
    while open_.any():
        first = int(np.argmax(open_))
        open_[first] = False
        stack = [first]
        while stack:
            at = stack.pop()
            near = np.flatnonzero(open_ & (np.bitwise_count(values ^ values[at]) <= radius))
            open_[near] = False
            stack += near.tolist()
            yield from ((int(values[at].view(np.int64)), int(values[i].view(np.int64))) for i in near)


def fingerprint_links(fps: DataFrame, radius: int = 4, bucket_limit: int = 256) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) whose components are those of all pairs within ``radius`` bits."""
    if radius % 2:
        raise ValueError("midpoints of large buckets need an even radius")
    masks = covering_masks(radius)
    rows = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).cast("tinyint").alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(masks)])).alias("c")).select("c.t", "c.k", "fp")
    full = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = rows.join(full.hint(SHUFFLED), ["t", "k"])
    small = met.where(F.col("n") <= bucket_limit).groupBy("t", "k").agg(F.collect_list("fp").alias("members")).select("members")

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {e for members in batch["members"] for e in _linked(np.asarray(members, np.int64), radius)}
            yield pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    free = [[i for i in range(BITS) if not m >> i & 1] for m in masks]
    half = radius // 2
    flips = [np.array([sum(1 << i for i in c) for k in range(half + 1) for c in combinations(bits, k)], np.uint64) for bits in free]

    def midpoints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t, part in batch.groupby("t"):
                own = part["fp"].to_numpy(np.int64).view(np.uint64)
                for at in range(0, len(own), 256):
                    near = (own[at : at + 256, None] ^ flips[t][None, :]).reshape(-1).view(np.int64)
                    yield pd.DataFrame({"t": np.int8(t), "z": near, "fp": np.repeat(own[at : at + 256].view(np.int64), len(flips[t]))})

    links = small.mapInPandas(forest, "a long, b long")
    large = met.where(F.col("n") > bucket_limit).select("t", "fp").mapInPandas(midpoints, "t byte, z long, fp long")
    least = large.groupBy("t", "z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("t", "z", "a")
    return links.union(large.join(least.hint(SHUFFLED), ["t", "z"]).where("a <> fp").select("a", F.col("fp").alias("b")).distinct())


def _rooted(docs: DataFrame, radius: int, width: int, bucket_limit: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, fp) of every row, and (fp, root, rows, least, one) of every fingerprint: the smallest fingerprint it
    reaches, the rows that have it, their smallest doc_id and the first of them by (null id, id, text)."""
    own = materialize(with_fingerprint(docs, width), "simhash")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    distinct = materialize(own.groupBy("fp").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least"), one.alias("one")), "prints")
    parts = connected_components(fingerprint_links(distinct.select("fp"), radius, bucket_limit))
    return own, distinct.join(parts.hint(SHUFFLED), F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("root"), "rows", "least", "one")


def simhash_components(docs: DataFrame, radius: int = 4, width: int = 4, bucket_limit: int = 256) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text; other columns are ignored).

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits.  Null and empty
    texts, and texts of white space, have fingerprint zero and are linked like any other.  Texts count whole, however
    long.  Repeated rows each give a row.  A null doc_id is kept and never becomes a component_id unless every member
    of the component is null.  An empty table gives an empty result.
    """
    own, root = _rooted(docs, radius, width, bucket_limit)
    root = materialize(root.select("fp", "root", "rows", "least"), "roots")
    smallest = materialize(root.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members")), "smallest")
    named = materialize(join_by_share(root, smallest, ["root"], "members", root.count()).select("fp", "component_id", "rows"), "named")
    return join_by_share(own, named, ["fp"], "rows", own.count()).select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, rooted: DataFrame, repeated: DataFrame) -> DataFrame:
    """One row of ``docs`` for each root of ``rooted`` (root, one), its first ``one``: (none, doc_id, h), null ids last.

    A row is known by its doc_id and text, so ids that are null or repeated do not let rows of other components go; of
    rows equal in both, which ``repeated`` (doc_id, h) lists, one stays.
    """
    keep = rooted.groupBy("root").agg(F.min("one").alias("one")).select(F.col("one.doc_id").alias("_velograph_d"), F.col("one.h").alias("_velograph_h"))
    same = F.col("doc_id").eqNullSafe(F.col("_velograph_d")) & F.col("h").eqNullSafe(F.col("_velograph_h"))
    keep = materialize(keep.join(repeated.select("doc_id", "h", F.lit(True).alias("twice")).hint(SHUFFLED), same, "left").select("_velograph_d", "_velograph_h", F.coalesce("twice", F.lit(False)).alias("twice")), "kept")
    marked = docs.withColumn("_velograph_own", F.xxhash64("text"))
    here = F.col("doc_id").cast("long").eqNullSafe(F.col("_velograph_d")) & F.col("_velograph_own").eqNullSafe(F.col("_velograph_h"))
    once = marked.join(keep.where("not twice").hint(SHUFFLED), here, "left_semi")
    many = marked.join(keep.where("twice").hint(SHUFFLED), here, "left_semi").dropDuplicates(["doc_id", "_velograph_own"])
    return once.union(many).drop("_velograph_own")


def drop_near_duplicates(docs: DataFrame, radius: int = 4, width: int = 4, bucket_limit: int = 256) -> DataFrame:
    """One row of ``docs`` for each component, as ``one_of_each`` picks it."""
    own, root = _rooted(docs, radius, width, bucket_limit)
    return one_of_each(docs, root, own.groupBy("doc_id", "h").agg(F.count("*").alias("rows")).where("rows > 1"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; nulls, ties and repeats as ``simhash_components`` says."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
