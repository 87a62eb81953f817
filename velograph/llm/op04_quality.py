"""Quality classifier: supervised subword embeddings.

Each token of a text gives a hashed word and hashed character n-grams (with its ends marked), each token that repeats
the one before it gives a feature of word pairs, and each text a number of padding features, which hold back the
scores of very short texts.  The text is the average of their learned vectors, and a softmax over two classes on top of it is the score.  Vectors and softmax are fitted
together by stochastic gradient descent in numpy, on a bounded sample of labelled documents.

After fitting, the model is linear in the average: a vector matters only through its product with the difference of
the two class weights.  Scoring therefore adds up one number for each n-gram, which token sums do once a token.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm.labelled import labelled_sample
from velograph.llm.tables import crc_remainder, table
from velograph.llm.token_sums import TokenSums, codes_of, grams

BUCKETS, WIDTH, SIZES = 1 << 16, 12, (2, 3, 4)
#: Two features behind the buckets: a repeated token (how often it counts) and padding (how many a text has).
PAIR, PADDING = BUCKETS, BUCKETS + 1
PAIR_TIMES, PADDING_TIMES = 8, 60
#: Labelled documents of a class that are learned from, at most.
PER_CLASS = 2_500
EPOCHS, RATE, SEED = 12, 0.5, 4
THRESHOLD = 0.3
MODULUS, HELD = 5, 0


class Model(NamedTuple):
    weights: np.ndarray  # one number a bucket: its vector times the difference of the class weights
    bias: float


def features(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, token) of each hashed feature of the tokens: the n-grams, and the word as a whole."""
    codes, owner = codes_of(tokens)
    hashes, owners = grams(codes, owner, SIZES)
    words = np.array([hash_word(t) for t in tokens], np.uint64)
    return (np.r_[hashes, words] % np.uint64(BUCKETS)).astype(np.int64), np.r_[owners, np.arange(len(tokens))]


def hash_word(token: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass"))


def repeats(tokens: list[str]) -> int:
    """Tokens that are the same as the one before."""
    return sum(map(str.__eq__, tokens, tokens[1:]))


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of a text's features."""
    counts = np.zeros(BUCKETS + 2)
    tokens = (text or "").split()
    for at in range(0, len(tokens), 20_000):
        distinct, times = np.unique(np.array(tokens[at : at + 20_000], object), return_counts=True)
        buckets, owner = features(distinct.tolist())
        counts += np.bincount(buckets, times[owner], BUCKETS + 2)
    counts[PAIR], counts[PADDING] = PAIR_TIMES * repeats(tokens), PADDING_TIMES
    found = np.flatnonzero(counts)
    return found, counts[found]


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float) -> Model:
    """Vectors and softmax from bags of features; ``prior`` is the share of class 1 that the scores should reflect."""
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS + 2, WIDTH))
    top, bias = rng.normal(0, 0.1, (WIDTH, 2)), np.zeros(2)
    if not len(labels):
        return Model(np.zeros(BUCKETS + 2), 0.0)
    counts = np.bincount(labels, minlength=2)
    weight = np.array([1 - prior, prior]) / np.maximum(counts, 1) * len(labels)
    shares = [(b, (c / c.sum())[:, None]) for b, c in bags]
    steps, done = EPOCHS * max(1, len(shares)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(shares)):
            b, share = shares[i]
            mean = (vectors[b] * share).sum(axis=0)
            z = mean @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = p * weight[labels[i]] * RATE * (1 - done / steps)
            done += 1
            back = top @ g
            top -= np.outer(mean, g)
            bias -= g
            vectors[b] -= share * back * min(1000.0, len(b) ** 0.5)
    return Model(vectors @ (top[:, 1] - top[:, 0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of ``labels.quality``, from at most ``per_class`` documents a class whose ids are not held out.

    Features are made where the texts are and the bounded sample is fitted in one task of an executor; the weights are
    all that comes to the driver.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bags = [bag(t) for t in batch["text"]]
            yield pd.DataFrame({"sample": 0, "doc_id": batch["doc_id"], "label": batch["label"].astype("int32"), "b": [b.astype(np.int32) for b, _ in bags], "c": [c.astype(np.float32) for _, c in bags]})

    rated = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), MODULUS) != HELD))
    share = rated.agg(F.avg("quality")).first()[0]
    prior = 0.5 if share is None else float(share)

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "label"], kind="stable")
        model = fit(list(zip(rows["b"], rows["c"], strict=True)), rows["label"].to_numpy(np.int64), prior)
        return pd.DataFrame({"weights": [model.weights.astype("<f8").tobytes()], "bias": [model.bias]})

    sample = labelled_sample(docs, labels, "quality", MODULUS, HELD, per_class).mapInPandas(run, "sample int, doc_id long, label int, b array<int>, c array<float>")
    found = sample.groupBy("sample").applyInPandas(learn, "weights binary, bias double").first()
    return Model(np.frombuffer(found["weights"], "<f8"), found["bias"]) if found else fit([], np.empty(0, np.int64), prior)


def quality_scores(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have padding as their only feature.  Texts count whole, however long, and equal texts have
    equal scores; other columns are ignored.  Ids may be null (hashed as the empty
    string) or repeated.  Without labels to learn from, all scores are 0.5.  An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, per_class))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias = model.value

        def make(tokens: list[str]) -> np.ndarray:
            buckets, owner = features(tokens)
            return np.stack([np.bincount(owner, weights[buckets], len(tokens)), np.bincount(owner, minlength=len(tokens))], axis=1)

        own = TokenSums(make, 2)
        for batch in batches:
            texts = batch["text"].tolist()
            total, count = own.sums(texts).T
            pairs = PAIR_TIMES * np.array([repeats(t.split()) if t else 0 for t in texts])
            total, count = total + pairs * weights[PAIR] + PADDING_TIMES * weights[PADDING], count + pairs + PADDING_TIMES
            score = 1 / (1 + np.exp(-np.clip(total / count + bias, -500, 500)))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": score, "predicted": (score >= threshold).astype("int32")})

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", (crc_remainder(doc_id, MODULUS) == HELD).alias("held_out")).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every document; nulls, repeats and long texts as ``quality_scores`` says."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
