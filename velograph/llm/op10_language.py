"""Language identification with a bit-sliced Bloom filter over character n-grams.

One filter serves all languages: each slot holds a bitmask of languages.  An n-gram sets its language's bit in
``HASHES`` slots; looking it up is the bitwise AND of those slots, which gives all languages that contain it at once.
A text's n-grams are counted for each language.  A language's filter answers yes to a foreign n-gram at a known rate
(its share of set slots to the power of ``HASHES``); each count is corrected by it, and the largest decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm.labelled import first_ids
from velograph.llm.tables import crc_remainder, table
from velograph.llm.token_sums import TokenSums, codes_of, grams
from velograph.plans.materialize import materialize

SIZES, HASHES = (2, 3, 4), 3
#: Slots are a power of two, at least so many for each n-gram of the largest language and this power in all.
SLOTS_A_GRAM, LEAST_BITS = 16, 19
#: Documents of a language that are learned from, at most.
PER_LANGUAGE = 500
UNKNOWN = "und"
MODULUS, HELD = 3, 1


class Filter(NamedTuple):
    languages: list[str]  # by code point
    masks: np.ndarray  # (slots, words of 64 languages)
    false_rate: np.ndarray  # for each language
    usual: int  # the language to name when nothing is found


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def token_grams(tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, token) of the n-grams of the lower-cased letters of tokens, and the number of letters of each token."""
    codes, owner = codes_of([t.lower() for t in tokens], letters())
    hashes, owners = grams(codes, owner, SIZES)
    return hashes, owners, np.bincount(owner, codes != 0, len(tokens))


def slots(hashes: np.ndarray, count: int) -> Iterator[np.ndarray]:
    """The ``HASHES`` slots, of ``count`` (a power of two of any size), of each hash: one half and an odd step of the other."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for k in range(HASHES):
        with np.errstate(over="ignore"):
            yield ((hashes + np.uint64(k) * step) & np.uint64(count - 1)).astype(np.int64)


def build(languages: list[str], found: dict[str, np.ndarray], usual: str | None) -> Filter:
    most = SLOTS_A_GRAM * max(map(len, found.values()), default=1)
    masks = np.zeros((1 << max((most - 1).bit_length(), LEAST_BITS), max(1, -(-len(languages) // 64))), np.uint64)
    rate = np.zeros(len(languages))
    for i, name in enumerate(languages):
        for s in slots(found.get(name, np.empty(0, np.uint64)), len(masks)):
            masks[s, i // 64] |= np.uint64(1 << (i % 64))
        rate[i] = np.mean((masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)) ** HASHES
    return Filter(languages, masks, rate, languages.index(usual) if usual else 0)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Filter:
    """The filter of the languages in ``docs`` (doc_id, text, lang), from documents whose ids are not held out.

    At most ``per_language`` documents of a language are read; all their n-grams, but those of a single document where there
    are 20 or more, are its own, whichever other languages they are also in.  What comes to the driver is bounded by
    the sample.  The table is read twice: for (doc_id, lang), which are written, and for the texts of the sample.
    """
    doc_id = F.col("doc_id").cast("long")
    fit = F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_remainder(doc_id, MODULUS) != HELD)
    own = docs.select(doc_id.alias("doc_id"), "text", "lang").where(fit)
    ids = materialize(own.select("doc_id", "lang"), "languages")
    counts = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return build([], {}, None)
    chosen = F.broadcast(first_ids(ids, F.col("lang"), per_language, counts).withColumnRenamed("label", "lang"))
    sample = own.join(chosen.select(F.col("doc_id").alias("_d"), F.col("lang").alias("_l")), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("lang") == F.col("_l"))).select("lang", "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                tokens = list(set(text.split()))
                if tokens:
                    yield pd.DataFrame({"lang": lang, "g": np.unique(token_grams(tokens)[0]).view(np.int64)})

    seen = sample.mapInPandas(run, "lang string, g long").groupBy("lang", "g").agg(F.count("*").alias("n"))
    sampled = F.element_at(F.create_map(*[x for name, n in counts.items() for x in (F.lit(name), F.lit(float(min(n, per_language))))]), F.col("lang"))
    kept = seen.where(F.col("n") >= F.when(sampled >= 20, 2).otherwise(1))
    rows = kept.select("lang", "g").toPandas()
    found = {name: part["g"].to_numpy(np.int64).view(np.uint64) for name, part in rows.groupby("lang")}
    return build(languages, found, min(languages, key=lambda name: (-counts[name], name)))


def languages_of(docs: DataFrame, fitted: Filter) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text).

    ``score`` is the winner's part of all corrected counts.  A text that is null or has no letter is ``und`` with score
    0; a text with letters of which no n-gram is known has the most usual language and score 0.  Ties go to the name
    first by code point.  Texts count whole, however long, and equal texts have equal answers.  Ids may be null or repeated; an empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        languages, masks, rate, usual = model.value
        names = np.array([*languages, UNKNOWN], object)

        def make(tokens: list[str]) -> np.ndarray:
            hashes, owner, count = token_grams(tokens)
            found = np.full((len(hashes), masks.shape[1]), np.uint64(0xFFFFFFFFFFFFFFFF))
            for s in slots(hashes, len(masks)):
                found &= masks[s]
            hits = [np.bincount(owner, ((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).astype(float), len(tokens)) for i in range(len(languages))]
            return np.stack([*hits, np.bincount(owner, minlength=len(tokens)), count], axis=1)

        own = TokenSums(make, len(languages) + 2)
        for batch in batches:
            sums = own.sums(batch["text"].tolist())
            hits, total, count = sums[:, :-2], sums[:, -2], sums[:, -1]
            right = np.maximum((hits - total[:, None] * rate) / np.maximum(1 - rate, 1e-9), 0.0)
            every = right.sum(axis=1)
            best = right.argmax(axis=1) if len(languages) else np.zeros(len(batch), np.int64)
            top = right.max(axis=1, initial=0.0)
            name = np.where(count > 0, names[np.where(every > 0, best, usual)], UNKNOWN)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "lang_pred": name, "score": np.where((count > 0) & (every > 0), top / np.maximum(every, 1e-300), 0.0)})

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", (crc_remainder(doc_id, MODULUS) == HELD).alias("held_out")).mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; nulls, repeats and long texts as ``languages_of`` says."""
    docs = table(spark, sf_dir, "documents")
    return languages_of(docs, train(docs))
