"""Cutting sequences into runs of windows that are chosen by content alone.

A window is ``window`` consecutive symbols of one document.  Its anchor is its k-gram with the smallest hash (the last
of several), so equal windows have equal anchors, wherever they stand.  Windows that share one anchor occurrence start
next to each other and form a run; the runs of a document hold each of its windows exactly once.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Low bits of a sliding key that hold the position; a block is never longer than these bits can count.
POSITION_BITS = 20
BLOCK = 1 << (POSITION_BITS - 1)


class Runs(NamedTuple):
    doc: np.ndarray  # index of the document
    first: np.ndarray  # first window start in the block
    count: np.ndarray  # number of windows
    anchor: np.ndarray  # hash of the anchor's symbols


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """A polynomial hash of every k-gram (k a power of two), by doubling, then mixed."""
    grams, width, factor = symbols, 1, _BASE
    with np.errstate(over="ignore"):
        while width < k:
            grams = grams[:-width] * factor + grams[width:]
            width, factor = width * 2, factor * factor
        grams = grams ^ (grams >> np.uint64(31))
        grams *= _MIX
        grams ^= grams >> np.uint64(29)
    return grams


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` consecutive values."""
    have = 1
    while have * 2 <= width:
        values, have = np.minimum(values[:-have], values[have:]), have * 2
    return values if have == width else np.minimum(values[: len(values) - (width - have)], values[width - have :])


def runs_of(symbols: np.ndarray, lengths: np.ndarray, window: int, k: int) -> Runs:
    """The runs of documents laid end to end; ``symbols`` are well-mixed 64-bit hashes, one for each symbol."""
    ends = np.cumsum(lengths)
    none = np.empty(0, np.int64)
    if len(symbols) < window:
        return Runs(none, none, none, none)
    grams = gram_hashes(symbols, k)
    low = np.uint64((1 << POSITION_BITS) - 1)
    keys = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
    at = (low - (sliding_min(keys, window - k + 1) & low)).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.flatnonzero(ends[doc[: len(at)]] - np.arange(len(at)) >= window)
    if not len(starts):
        return Runs(none, none, none, none)
    anchor = at[starts]
    new = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    return Runs(doc[starts[new]], starts[new], np.diff(np.r_[new, len(starts)]), grams[anchor[new]].view(np.int64))
