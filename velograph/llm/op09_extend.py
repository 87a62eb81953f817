"""Repeated word passages by seed and extend.

Winnowed anchors (rare eight-word grams chosen by content) are the seeds on which documents are joined: ``repeats``
brings all different contents around one anchor together.  A match is extended from its seed both ways in lockstep:
contents are split into classes by their first l words to the left of the anchor and by their first r words to the
right, each class refined from the one before by a single further word.  Two contents in one class on both sides with
l + r as long as the threshold share a whole window, and the union of such windows is the union of the maximal
repeats of at least that length.  Classes make this linear in the contents: no pair is ever formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession

from velograph.llm.repeats import Unit, covered, keyed, repeated_spans, with_spans
from velograph.llm.tables import table
from velograph.llm.winnow_kernel import gram_hashes

WINDOW = 35
GRAM = 8


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of bytes other than the six ASCII white spaces, unchanged."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _encode(text: str | None) -> bytes:
    return np.array([xxhash.xxh3_64_intdigest(w) for w in words_of(text)], "<u8").tobytes()


def _hashes(symbols: bytes) -> np.ndarray:
    return np.frombuffer(symbols, "<u8").astype(np.uint64)


def word_unit(window: int = WINDOW, k: int = GRAM) -> Unit:
    return Unit(window, k, 8, _encode, _hashes)


def _refined(classes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Classes of equal (class, word); classes stay numbered from 0."""
    _, words = np.unique(words, return_inverse=True)
    _, out = np.unique(classes * (int(words.max(initial=0)) + 1) + words, return_inverse=True)
    return out


def extended(contents: list[bytes], anchors: np.ndarray, window: int = WINDOW, k: int = GRAM) -> list[np.ndarray]:
    """For each content, which of its windows is also in another content with its anchor."""
    symbols = [np.frombuffer(c, "<u8").astype(np.uint64) for c in contents]
    flanks = window - k
    places: list[int] = []
    for s, m in zip(symbols, anchors.view(np.uint64) if anchors.dtype == np.int64 else anchors, strict=True):
        count = len(s) - window + 1
        hits = np.flatnonzero(gram_hashes(s, k) == m)
        # the anchor is in every window of its run; the last such place is the one that was chosen
        places.append(int(hits[(hits >= count - 1) & (hits <= flanks)][-1]))
    at = np.array(places)
    lengths = np.array([len(s) for s in symbols])
    flat, base = np.concatenate(symbols), np.cumsum(lengths) - lengths
    _, left = np.unique(anchors, return_inverse=True)
    lefts, rights = [left], [left]
    row = np.arange(len(at))
    for step in range(1, flanks + 1):
        inside = at - step >= 0
        word = flat[base + np.where(inside, at - step, 0)]
        lefts.append(np.where(inside, _refined(lefts[-1], word), len(at) + row))  # past the content each is alone
        inside = at + k - 1 + step < lengths
        word = flat[base + np.where(inside, at + k - 1 + step, 0)]
        rights.append(np.where(inside, _refined(rights[-1], word), len(at) + row))
    masks = [np.zeros(max(0, n - window + 1), bool) for n in lengths.tolist()]
    for before in range(flanks + 1):
        first = at - before
        live = np.flatnonzero((first >= 0) & (first + window <= lengths))
        if len(live):
            both = lefts[before][live] * (2 * len(at) + 1) + rights[flanks - before][live]
            _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
            for i in live[counts[inverse] > 1].tolist():
                masks[i][first[i]] = True
    return masks


def passage_spans(src: DataFrame, window: int = WINDOW, k: int = GRAM, **limits) -> DataFrame:
    """The keyed documents ``src`` with begins and ends of the spans of words that repeat elsewhere."""
    return with_spans(src, repeated_spans(src, word_unit(window, k), lambda contents, anchors: extended(contents, anchors, window, k), **limits))


def digest_removed_words(docs: DataFrame, window: int = WINDOW, k: int = GRAM, **limits) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by a space).

    Null, empty and blank texts have no words and the digest of nothing.  Texts count whole; long ones are cut into
    overlapping blocks on the way, so that no window is lost.  Repeated rows repeat each other; ids that are null or
    repeated keep their rows.  An empty table gives an empty result.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, begins, ends in zip(batch["text"], batch["begins"], batch["ends"], strict=True):
                words = words_of(text)
                gone = covered(begins, ends, len(words))
                kept = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if begins is not None else b" ".join(words)
                out.append((len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
            rest = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])
            yield pd.concat([batch["d"].astype("Int64").rename("doc_id").reset_index(drop=True), rest], axis=1)

    found = passage_spans(keyed(docs), window, k, **limits)
    return found.select("d", "text", "begins", "ends").mapInPandas(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 35-word passages; see ``digest_removed_words`` for nulls and repeats."""
    return digest_removed_words(table(spark, sf_dir, "documents"))
