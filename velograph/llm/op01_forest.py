"""Approximate nearest neighbours with a hash-prefix forest.

Each of ``trees`` trees hashes a vector to a string of ``BITS`` bits: signs of its projections on the axes of a random
rotation, against the medians of a bounded sample, so that every bit halves the data.  A tree is the array of its
strings in order.  A query descends in each array to the strings with the longest common prefix and then ascends in
all trees together, a bit at a time, until the strings that share so long a prefix number ``wanted`` over all trees.
All vectors behind them are compared with the query exactly.

Arrays are kept in shards by their first bits, a few bits above the level at which queries are expected to stop; a
shard of more than ``shard_rows`` strings is dealt out further by a hash, and its queries go to each part.  Queries
that find too few strings in their shards, in a sparse part of the hashes, ascend further, in shards of fewer bits, up
to the whole array.  Equal vectors are one string with up to ``k + 1`` ids, however many rows they stand for, and equal
queries are one search.  Vectors travel with as many bytes as they were given with.

How many candidates are needed depends on the data, so it is measured: the nearest of ``PROBES`` sampled queries are found
by brute force over all rows, and ``wanted`` grows from ``wanted_of`` until the search would find ``TARGET`` of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import floor, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velograph.llm.tables import table
from velograph.plans.materialize import materialize, release

BITS = 60
TREES = 24
#: Vectors from which the medians are taken, at most.
SAMPLE = 2_000
#: Levels above the shards' that a query's search distinguishes; deeper strings count as this deep.
LEVELS = 20
#: Vectors of a shard at most, and bytes of them, whichever is less.
SHARD_ROWS, SHARD_BYTES = 16_384, 32 << 20
EVERY = 100
#: Queries whose recall is measured, and the recall that they need: 0.9 and a margin for the sample's error.
PROBES, TARGET, GROWTH = 128, 0.93, 1.2


def wanted_of(rows: int) -> int:
    """Strings over all trees that a query looks at, before recall is measured.

    4,096, or 14 * rows ** 0.69 if that is more: the exponent is that of sign hashing for neighbours at 0.78 of the
    distance of the rest, as nearest vectors in 64 even dimensions are.
    """
    return max(4_096, floor(14 * rows**0.69))


def valid(vector: Column) -> Column:
    """Whether a vector takes part: not null, all components finite, some component other than zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotations(dim: int, trees: int) -> np.ndarray:
    """(trees, dim, BITS) projection directions; up to ``dim`` at a time are at right angles."""
    rng = np.random.default_rng([dim, 11])
    out = np.empty((trees, dim, BITS))
    for t in range(trees):
        for b in range(0, BITS, dim):
            out[t, :, b : b + dim] = np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : BITS - b]
    return out


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(c1, c2, dim, vector, ids): each distinct vector and its ``keep`` smallest ids; each task sends on so many."""
    keyed = rows.select("vec_id", "vector", F.xxhash64("vector").alias("c1"), F.xxhash64(F.lit(1), "vector").alias("c2"))
    ranked = keyed.withColumn("_k", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("vec_id"))).where(F.col("_k") <= keep)
    return ranked.groupBy("c1", "c2").agg(F.first("vector").alias("vector"), F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("vector"))


def _floats(rows: DataFrame) -> str:
    """The numpy type of the bytes that hold a vector of ``rows`` exactly."""
    return "<f4" if rows.schema["vector"].dataType.elementType.typeName() == "float" else "<f8"


def _hashed(distinct: DataFrame, medians: dict[int, np.ndarray], trees: int) -> DataFrame:
    """(c1, c2, dim, v, ids, hashes): the vector as bytes and its hash in each tree."""
    spark, kind = distinct.sparkSession, _floats(distinct)
    fitted = spark.sparkContext.broadcast(medians)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        axes: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                v = np.stack(part["vector"].tolist()).astype(np.float64)
                if dim not in axes:
                    axes[dim] = rotations(dim, trees)
                middle = fitted.value.get(dim, np.zeros((trees, BITS)))
                hashes = np.stack([((v @ axes[dim][t] > middle[t]) * bits).sum(axis=1) for t in range(trees)], axis=1)
                yield pd.DataFrame({"c1": part["c1"], "c2": part["c2"], "dim": part["dim"], "v": [x.tobytes() for x in v.astype(kind)], "ids": part["ids"], "hashes": list(hashes)})

    return distinct.select("c1", "c2", "dim", "vector", "ids").mapInPandas(run, "c1 long, c2 long, dim int, v binary, ids array<long>, hashes array<long>")


def _medians(distinct: DataFrame, sample: int, trees: int) -> dict[int, np.ndarray]:
    """Medians of the projections of at most ``sample`` vectors, those with the smallest hash."""
    rows = distinct.select("dim", "vector", "c1", "c2").orderBy("c1", "c2").limit(sample).toPandas()
    return {int(dim): np.median(np.einsum("nd,tdb->ntb", np.stack(part["vector"].tolist()).astype(float), rotations(int(dim), trees)), axis=0) for dim, part in rows.groupby("dim")}


def _shared_bits(sorted_: np.ndarray, own: int, level: int) -> tuple[int, int]:
    """The stretch of a sorted array whose strings share the first ``level`` bits with ``own``."""
    shift = BITS - level
    first = (own >> shift) << shift
    return int(np.searchsorted(sorted_, first)), int(np.searchsorted(sorted_, first + (1 << shift)))


def _base(rows: int, trees: int, wanted: int) -> int:
    """Bits of a shard's prefix."""
    return max(0, min(BITS - LEVELS, floor(log2(max(1, rows * trees / wanted))) - 3))


def _probed(index: DataFrame, asking: DataFrame, k: int, kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each sampled query: strings that share at least so many bits with it, and the bits that its ``k`` nearest
    share with it in their best tree."""
    probes = asking.select("c1", "c2", "dim", "v", "hashes").orderBy("c1", "c2").limit(PROBES).toPandas()
    sent = index.sparkSession.sparkContext.broadcast(probes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probes = sent.value
        shared = np.zeros((len(probes), BITS + 1), np.int64)
        nearest_ = [(np.empty(0), np.empty(0, np.int64))] * len(probes)
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                v = np.frombuffer(b"".join(part["v"]), kind).astype(np.float64).reshape(len(part), -1)
                hashes = np.stack(part["hashes"].tolist())
                for i in np.flatnonzero(probes["dim"].to_numpy() == dim).tolist():
                    x = hashes ^ np.asarray(probes["hashes"].iloc[i])
                    # without the bit after each set one, rounding to a double cannot reach the next power of two
                    bits = BITS - np.frexp((x & ~(x >> 1)).astype(np.float64))[1]
                    shared[i] += np.bincount(bits.ravel(), minlength=BITS + 1)
                    score = np.square(v - np.frombuffer(probes["v"].iloc[i], kind)).sum(axis=1)
                    other = (part["c1"].to_numpy() != probes["c1"].iloc[i]) | (part["c2"].to_numpy() != probes["c2"].iloc[i])
                    score, best = np.concatenate([nearest_[i][0], score[other]]), np.concatenate([nearest_[i][1], bits.max(axis=1)[other]])
                    first = np.argsort(score, kind="stable")[:k]
                    nearest_[i] = score[first], best[first]
        yield pd.DataFrame({"q": range(len(probes)), "shared": list(shared), "score": [s for s, _ in nearest_], "bits": [b for _, b in nearest_]})

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        score, bits = np.concatenate(group["score"].tolist()), np.concatenate(group["bits"].tolist())
        return pd.DataFrame({"shared": [np.sum(group["shared"].tolist(), axis=0)], "bits": [bits[np.argsort(score, kind="stable")[:k]]]})

    partial = index.select("c1", "c2", "dim", "v", "hashes").mapInPandas(run, "q int, shared array<long>, score array<double>, bits array<long>")
    found = partial.groupBy("q").applyInPandas(merge, "shared array<long>, bits array<long>").toPandas()
    return [(np.cumsum(np.asarray(s)[::-1])[::-1], np.asarray(b)) for s, b in zip(found["shared"], found["bits"], strict=True)]


def _enough(probed: list[tuple[np.ndarray, np.ndarray]], rows: int, trees: int) -> int:
    """The least ``wanted`` from ``wanted_of`` on with which the probes' recall is ``TARGET``."""
    wanted = wanted_of(rows)
    while wanted < rows * trees:
        base = _base(rows, trees, wanted)
        hits = []
        for shared, bits in probed:
            level = max((i for i in range(base, base + LEVELS + 1) if shared[i] >= wanted), default=base)
            hits += (bits >= level).tolist()
        if not hits or np.mean(hits) >= TARGET:
            return wanted
        wanted = min(rows * trees, floor(wanted * GROWTH))
    return wanted


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, *, trees: int = TREES, wanted: int | None = None, sample: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` nearest found of each query row of ``vectors`` (vec_id, embedding).

    Candidates are all rows with another vec_id and a vector of the same length; the score is the Euclidean distance in
    double precision, ties go to the smaller vec_id.  Null, zero, and partly null or non-finite vectors take no part,
    nor do rows without an id.  Rows that repeat a vec_id do not find each other and are one candidate and one query:
    their distance is that of the nearest of them.  With fewer candidates than ``k`` all are returned; an empty table
    gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & valid(F.col("vector")))
    kind = _floats(rows)
    distinct = materialize(_distinct(rows, k + 1), "vectors")
    count = distinct.count()
    index = materialize(_hashed(distinct, _medians(distinct, sample, trees), trees), "strings")
    asked = rows.where("asks").select("vec_id", F.xxhash64("vector").alias("c1"), F.xxhash64(F.lit(1), "vector").alias("c2")).distinct()
    asking = materialize(index.join(asked.select("c1", "c2").distinct(), ["c1", "c2"], "left_semi"), "asking")
    release(distinct)
    if wanted is None:
        wanted = wanted_of(count)
        if wanted < count * trees:
            wanted = _enough(_probed(index, asking, k, kind), count, trees)
    base, found = _base(count, trees, wanted), []
    while True:
        hits, sparse = _searched(index, asking, base, wanted, k, shard_rows, kind)
        found.append(hits)
        if base == 0 or sparse.isEmpty():
            break
        base, asking = max(0, base - LEVELS // 2), sparse
    best = reduce(DataFrame.union, found).groupBy("c1", "c2", "vec_id").agg(F.min("score").alias("score"))
    best = best.withColumn("_k", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("score", "vec_id"))).where(F.col("_k") <= k + 1)
    lists = best.groupBy("c1", "c2").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("found"))
    answers = asked.join(lists, ["c1", "c2"]).select(F.col("vec_id").alias("query_id"), F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("vec_id")), 1, k).alias("found"))
    # of a repeated id with several vectors, the lists are one list
    answers = answers.groupBy("query_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    nearest_ = F.transform(F.array_distinct(F.transform("found", lambda x: x["vec_id"])), lambda i: F.struct(F.array_min(F.transform(F.filter("found", lambda x: x["vec_id"] == i), lambda x: x["score"])).alias("score"), i.alias("vec_id")))
    answers = answers.select("query_id", F.posexplode(F.slice(F.array_sort(nearest_), 1, k)).alias("rank", "hit"))
    return answers.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")


def _searched(index: DataFrame, asking: DataFrame, base: int, wanted: int, k: int, shard_rows: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """(c1, c2, score, vec_id) found for the queries ``asking`` in shards of ``base`` bits, and the queries that have fewer
    than ``wanted`` strings in these."""

    def placed(some: DataFrame, *columns: str) -> DataFrame:
        every = some.select("dim", *columns, F.posexplode("hashes").alias("tree", "hash"))
        return every.withColumn("prefix", F.shiftright("hash", BITS - base) if base else F.lit(0).cast("long"))

    shard = ["dim", "tree", "prefix"]
    parts = placed(index).groupBy(*shard).agg(F.ceil(F.greatest(F.count("*") / shard_rows, F.count("*") * F.col("dim") * int(kind[-1]) / SHARD_BYTES)).cast("int").alias("parts"))
    parts = materialize(parts, "shards")
    strings = placed(index, "c1", "c2", "v", "ids").join(parts, shard).withColumn("salt", F.pmod(F.col("c1"), F.col("parts")).cast("int")).drop("parts")
    spread = lambda some: some.join(parts, shard).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    keys = [*shard, "salt"]

    def counts(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        array = np.sort(own["hash"].to_numpy())
        out = []
        for c1, c2, h in zip(queries["c1"], queries["c2"], queries["hash"], strict=True):
            ends = [_shared_bits(array, h, base + i) for i in range(LEVELS + 1)]
            out.append((c1, c2, *[e - b for b, e in ends]))
        return pd.DataFrame(out, columns=["c1", "c2", *[f"n{i}" for i in range(LEVELS + 1)]])

    numbers = [f"n{i}" for i in range(LEVELS + 1)]
    questions = spread(placed(asking, "c1", "c2"))
    seen = strings.select(*keys, "hash").groupBy(*keys).cogroup(questions.groupBy(*keys)).applyInPandas(counts, "c1 long, c2 long, " + ", ".join(f"{n} long" for n in numbers))
    total = seen.groupBy("c1", "c2").agg(*[F.sum(n).alias(n) for n in numbers])
    depth = F.greatest(*[F.when(F.col(n) >= wanted, i).otherwise(0) for i, n in enumerate(numbers)])
    enough = F.lit(True) if base == 0 else F.col("n0") >= wanted
    levels = materialize(total.select("c1", "c2", (depth + base).alias("level"), enough.alias("enough")), "levels")

    def compare(own: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("hash", kind="stable")
        array, ids = own["hash"].to_numpy(), own["ids"].tolist()
        if not len(queries) or not len(own):
            return pd.DataFrame({"c1": [], "c2": [], "score": [], "vec_id": []}).astype({"c1": "int64", "c2": "int64", "vec_id": "int64"})
        v = np.frombuffer(b"".join(own["v"]), kind).astype(np.float64).reshape(len(own), -1)
        least = np.array([x[0] for x in ids])
        out = []
        for c1, c2, h, level, q in zip(queries["c1"], queries["c2"], queries["hash"], queries["level"], queries["v"], strict=True):
            b, e = _shared_bits(array, h, level)
            if b == e:
                continue
            away = v[b:e] - np.frombuffer(q, kind)
            score = np.sqrt(np.square(away).sum(axis=1))
            # the (k + 1)-th distance bounds what can be among the nearest, ties included
            near = np.flatnonzero(score <= np.partition(score, min(k, len(score) - 1))[min(k, len(score) - 1)])
            near = near[np.lexsort((least[b:e][near], score[near]))][: k + 1]
            out += [(c1, c2, score[i], x) for i in near.tolist() for x in ids[b + i]]
        return pd.DataFrame(out, columns=["c1", "c2", "score", "vec_id"]).astype({"c1": "int64", "c2": "int64", "vec_id": "int64", "score": "float64"})

    deep = spread(placed(asking.join(levels.where("enough"), ["c1", "c2"]), "c1", "c2", "v", "level"))
    found = strings.select(*keys, "hash", "v", "ids").groupBy(*keys).cogroup(deep.groupBy(*keys)).applyInPandas(compare, "c1 long, c2 long, score double, vec_id long")
    return found, asking.join(levels.where("not enough"), ["c1", "c2"], "left_semi")


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth row; unfit vectors, ties and repeated ids as ``nearest`` says."""
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % EVERY == 0)
