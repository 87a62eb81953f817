"""SimHash of word shingles: the part that runs over one text at a time.

Words are the maximal runs of bytes other than space and the five ASCII control spaces (``bytes.split()`` splits
at exactly those), lower-cased for A-Z only.  A text with fewer words than a shingle gives one shingle of the whole
sequence; a text without words gives fingerprint zero.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import xxhash

SEED = 42
#: Shingles whose bits are counted at once; bounds the memory a very long text needs.
BLOCK = 1 << 15

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, width: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of each ``width``-word shingle of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: len(words) - width + 1].tolist()
    return np.array([digest(joined[b:e], SEED) for b, e in zip(begins, ends[width - 1 :].tolist(), strict=True)], np.uint64)


def majority_bits(hashes: np.ndarray) -> int:
    """The 64-bit number whose bit i is set if more than half of the hashes have bit i set."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        octets = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(texts: Iterable[str | None], width: int = 4) -> np.ndarray:
    """A signed 64-bit fingerprint for each text."""
    return np.array([majority_bits(shingle_hashes(t, width)) for t in texts], np.uint64).view(np.int64)
