"""Token counts of whole texts, with overlap resynchronisation for huge ones.

A text up to ``chunk`` characters is encoded as it is.  A longer one is cut into overlapping chunks that are encoded
with offsets on any executor.  Neighbouring chunks are spliced at a place in their overlap where both begin a
pre-token.  Such a place is proven: a pre-token depends only on the text from its start on, up to one or two characters
behind its end, so the left chunk's starts are those of the whole text except near its right edge (``MARGIN``), and
once both chunks start a pre-token at one place they agree from there on.  Where an overlap has no common start it is
widened for those documents alone, up to a chunk that holds the whole text.

Texts of one chunk go through a table of counted words first: a space after a character that is no white space always
starts a pre-token, so the count of a text is the sum over its pieces, and the library encodes each new piece once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm.tables import table
from velograph.plans.materialize import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LIMIT = 1024
#: Characters before a chunk's end where its pre-tokens may differ from the whole text's; no special string is longer.
MARGIN = 64
#: Pieces whose counts a worker keeps.
KEPT_PIECES = 400_000
#: Pieces longer than this are not kept.
PIECE_CHARS = 64


class Counter:
    """Counts of a tokenizer file, with added special tokens left out and special strings in a text as by default."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(len(t.content) > MARGIN - 4 for t in added):
            raise ValueError("a special string is longer than the margin")
        self.by_piece = not any(t.lstrip or t.rstrip or t.single_word or any(c.isspace() for c in t.content) for t in added) and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.known: dict[str, int] = {}

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def pieces(self, text: str) -> list[str]:
        """The text cut before each space that follows a character other than white space."""
        parts = text.split(" ")
        if len(parts) == 1:
            return parts
        out, held = [], parts[0]
        for part in parts[1:]:
            if held and not held[-1].isspace():
                out.append(held)
                held = " " + part
            else:
                held += " " + part
        out.append(held)
        return out

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_piece:
            return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        cut = [self.pieces(t) for t in texts]
        known = self.known
        if len(known) > KEPT_PIECES:
            known.clear()
        new = list({p for pieces in cut for p in pieces if p not in known})
        fresh = dict(zip(new, (len(e) for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True)) if new else {}
        known |= {p: n for p, n in fresh.items() if len(p) <= PIECE_CHARS}
        long = {p: n for p, n in fresh.items() if len(p) > PIECE_CHARS}
        return [sum([known[p] if p in known else long[p] for p in pieces]) for pieces in cut]


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def starts_of(encoding) -> tuple[np.ndarray, np.ndarray]:
    """(places, tokens before) of each pre-token of an encoding."""
    words = np.array(encoding.word_ids, np.int64)
    first = np.flatnonzero(np.r_[True, words[1:] != words[:-1]]) if len(words) else np.empty(0, np.int64)
    places = np.array([b for b, _ in encoding.offsets], np.int64)
    return places[first], first


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("d"), text.alias("text")).withColumn("h", F.xxhash64("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))


def _spliced(long: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(d, h, n_tokens, failed) of texts longer than ``chunk``, each cut into chunks that share ``overlap`` characters."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for d, h, text in zip(batch["d"].astype("Int64"), batch["h"], batch["text"], strict=True):
                begins = range(0, max(1, len(text) - overlap), chunk - overlap)
                for at in range(0, len(begins), 16):
                    own = begins[at : at + 16]
                    yield pd.DataFrame({"d": pd.array([d] * len(own), "Int64"), "h": h, "i": [b // (chunk - overlap) for b in own], "begin": list(own), "more": [b + chunk < len(text) for b in own], "part": [text[b : b + chunk] for b in own]})

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for batch in batches:
            out = []
            for begin, more, part in zip(batch["begin"], batch["more"], batch["part"], strict=True):
                encoding = own.encode(part)
                places, before = starts_of(encoding)
                head = (places < overlap - MARGIN) if begin else np.zeros(len(places), bool)
                tail = ((places >= chunk - overlap) & (places < chunk - MARGIN)) if more else np.zeros(len(places), bool)
                out.append((len(encoding), (places[head] + begin).tolist(), before[head].tolist(), (places[tail] + begin).tolist(), before[tail].tolist()))
            yield pd.concat([batch[["d", "h", "i", "more"]].astype({"d": "Int64"}).reset_index(drop=True), pd.DataFrame(out, columns=["n", "hp", "hc", "tp", "tc"])], axis=1)

    chunks = long.select("d", "h", "text").mapInPandas(cut, "d long, h long, i long, begin long, more boolean, part string")
    dealt = chunks.repartition("h", "i")
    parts = dealt.mapInPandas(encode, "d long, h long, i long, more boolean, n long, hp array<long>, hc array<long>, tp array<long>, tc array<long>")
    parts = materialize(parts, "chunks").dropDuplicates(["d", "h", "i"])
    left = parts.where("more").select("d", "h", (F.col("i") + 1).alias("i"), F.col("n").alias("ln"), "tp", "tc")
    right = parts.where("i > 0").select(F.col("d").alias("_d"), F.col("h").alias("_h"), F.col("i").alias("_i"), "hp", "hc")
    at = F.array_min(F.array_intersect("tp", "hp"))
    count_at = lambda places, counts: F.element_at(counts, F.array_position(places, F.col("at")).cast("int"))
    joint = left.join(right, F.col("d").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")) & (F.col("i") == F.col("_i"))).withColumn("at", at)
    change = F.when(F.col("at").isNotNull(), count_at("tp", "tc") - F.col("ln") - count_at("hp", "hc"))
    whole = parts.select("d", "h", F.col("n").alias("change"), F.lit(False).alias("failed"))
    every = whole.union(joint.select("d", "h", F.coalesce(change, F.lit(0)).alias("change"), F.col("at").isNull().alias("failed")))
    return every.groupBy("d", "h").agg(F.sum("change").alias("n_tokens"), F.max("failed").alias("failed"))


def token_counts(docs: DataFrame, path: str = VOCABULARY, *, limit: int = LIMIT, chunk: int = 32_768, overlap: int = 1_024) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_bytes, n_tokens, over_limit.

    Null texts count as empty: no bytes, no tokens.  Ids may be null or repeated; an empty table gives an empty result.
    """
    if not 2 * MARGIN < overlap < chunk:
        raise ValueError("an overlap is longer than two margins and shorter than a chunk")
    src = _keyed(docs)

    def direct(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = counter(path)
        for batch in batches:
            counts: list[int] = []
            for at in range(0, len(batch), 256):
                counts += own.count(batch["text"].iloc[at : at + 256].tolist())
            yield pd.DataFrame({"d": batch["d"].astype("Int64"), "n_bytes": batch["n_bytes"], "n_tokens": np.array(counts, np.int64)})

    short = src.where(F.length("text") <= chunk).select("d", "text", "n_bytes").mapInPandas(direct, "d long, n_bytes long, n_tokens long")
    long = src.where(F.length("text") > chunk)
    todo, done = long, None
    while True:
        tried = materialize(_spliced(todo, path, chunk, overlap), "spliced")
        good = tried.where("not failed").select("d", "h", "n_tokens")
        done = good if done is None else done.union(good)
        if tried.where("failed").isEmpty():
            break
        failed = tried.where("failed").select(F.col("d").alias("_d"), F.col("h").alias("_h"))
        todo = long.join(failed, F.col("d").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")), "left_semi")
        overlap, chunk = overlap * 8, max(chunk, overlap * 32)
    found = done.select(F.col("d").alias("_d"), F.col("h").alias("_h"), "n_tokens")
    rest = long.select("d", "h", "n_bytes").join(found, F.col("d").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h"))).select("d", "n_bytes", "n_tokens")
    return short.union(rest).select(F.col("d").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; nulls, repeats and long texts as ``token_counts`` says."""
    return token_counts(table(spark, sf_dir, "documents"))
