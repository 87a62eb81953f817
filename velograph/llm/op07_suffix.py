"""Exact substring deduplication of bytes with suffix arrays built by induced sorting.

``repeats`` narrows the corpus, without loss, to short contents that share an anchor but differ; they arrive in shards
that hold whole anchors, so equal 200-byte strings are always in one shard.  A shard is laid out as one string with
separators, its suffix array is induced (``suffix_kernel``), and its permuted longest common prefixes tell which
starts share their first 200 bytes with a neighbour in the array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm.repeats import Unit, covered, keyed, repeated_spans, with_spans
from velograph.llm.suffix_kernel import permuted_lcp, suffix_array
from velograph.llm.tables import table

WINDOW = 200
_OCTETS = np.random.default_rng(200).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _hashes(symbols: bytes) -> np.ndarray:
    return _OCTETS[np.frombuffer(symbols, np.uint8)]


def byte_unit(window: int = WINDOW, k: int = 64) -> Unit:
    return Unit(window, k, 1, _encode, _hashes)


def repeated_starts(contents: list[bytes], window: int = WINDOW) -> list[np.ndarray]:
    """For each content, which of its window starts share their first ``window`` bytes with another start."""
    lengths = np.array([len(c) for c in contents], np.int64)
    text = np.zeros(int(lengths.sum()) + len(contents), np.uint16)
    begins = np.cumsum(lengths + 1) - lengths - 1
    for b, c in zip(begins.tolist(), contents, strict=True):
        text[b : b + len(c)] = np.frombuffer(c, np.uint8).astype(np.uint16) + 1
    array = suffix_array(text, 257)
    left = permuted_lcp(text, array)
    shared = np.zeros(len(text), bool)
    pairs = np.flatnonzero(left[array[1:]] >= window)
    shared[array[1:][pairs]] = shared[array[:-1][pairs]] = True
    # a common prefix of two windows that reach a separator may go on across it; such starts hold no whole window
    return [shared[b : b + max(0, n - window + 1)] for b, n in zip(begins.tolist(), lengths.tolist(), strict=True)]


def suffix_spans(src: DataFrame, window: int = WINDOW, **limits) -> DataFrame:
    """The keyed documents ``src`` with begins and ends of the repeated byte spans of each text."""
    return with_spans(src, repeated_spans(src, byte_unit(window), lambda contents, _: repeated_starts(contents, window), **limits))


def digest_removed(docs: DataFrame, window: int = WINDOW, **limits) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null and empty texts have no bytes and the digest of nothing.  Texts count whole; long ones are cut into
    overlapping blocks on the way, so that no window is lost.  Rows repeated in the table repeat each other, so long
    ones lose everything; ids that are null or repeated keep their rows.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, begins, ends in zip(batch["text"], batch["begins"], batch["ends"], strict=True):
                own = _encode(text)
                gone = covered(begins, ends, len(own))
                kept = np.frombuffer(own, np.uint8)[~gone].tobytes() if begins is not None else own
                out.append((len(own), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(np.int8)]) > 0).sum()), hashlib.sha256(kept).hexdigest()))
            rest = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])
            yield pd.concat([batch["d"].astype("Int64").rename("doc_id").reset_index(drop=True), rest], axis=1)

    found = suffix_spans(keyed(docs), window, **limits)
    return found.select("d", "text", "begins", "ends").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the repeated bytes of each text removed; n_chars, where there is one, is counted anew.

    A character of which only some bytes are removed goes whole.  Null texts stay null; a text may become empty.  All
    rows and columns are kept, whatever their names; rows with null or repeated ids are known by their text too.
    """

    @F.pandas_udf("string")
    def kept(texts: pd.Series, begins: pd.Series, ends: pd.Series) -> pd.Series:
        out = []
        for text, b, e in zip(texts, begins, ends, strict=True):
            own = _encode(text)
            out.append(None if b is None else np.frombuffer(own, np.uint8)[~covered(b, e, len(own))].tobytes().decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    found = suffix_spans(keyed(docs, rest), window)
    changed = F.col("begins").isNotNull()
    found = found.withColumn("kept", kept(F.when(changed, F.col("text")), "begins", "ends"))
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))

    def column(name: str) -> Column:
        if name == "text":
            return text.alias(name)
        own = F.col("row").getField(name)
        return (F.when(changed, F.length("kept").cast(docs.schema[name].dataType)).otherwise(own) if name == "n_chars" else own).alias(name)

    return found.select(*[column(c) for c in docs.columns])


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 200-byte strings; see ``digest_removed`` for nulls and repeats."""
    return digest_removed(table(spark, sf_dir, "documents"))
