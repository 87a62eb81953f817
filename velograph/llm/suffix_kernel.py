"""Suffix arrays by induced sorting, and permuted longest common prefixes.

The suffixes are classified as smaller or larger than their right neighbour.  The leftmost smaller ones (LMS) are
sorted by their substrings, which get names; where names repeat, the suffix array of the string of names is made in the
same way, recursively, and gives their order.  The order of all suffixes is then induced from the LMS suffixes in two
linear passes.  Over few symbols the passes go bucket by bucket, so that numpy moves all entries of a bucket at once;
over many, as strings of names have, buckets hold an entry or two and the passes go entry by entry.
"""

from __future__ import annotations

import numpy as np

#: Mean entries of a bucket from which numpy moves whole buckets.
ENTRIES_A_BUCKET = 64


def _smaller(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour; the last one is larger than the empty suffix."""
    n = len(text)
    ends = np.flatnonzero(np.r_[text[1:] != text[:-1], True])
    up = np.zeros(len(ends), bool)
    up[:-1] = text[ends[:-1] + 1] > text[ends[:-1]]
    return np.repeat(up, np.diff(np.r_[-1, ends])) if n else np.zeros(0, bool)


def _dealt(found: np.ndarray, symbols: np.ndarray, lists: list[list[np.ndarray]]) -> None:
    """Append each position to the list of its symbol, keeping the order."""
    order = np.argsort(symbols, kind="stable")
    found, symbols = found[order], symbols[order]
    cuts = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]]).tolist()
    for b, e in zip(cuts, [*cuts[1:], len(found)], strict=True):
        lists[symbols[b]].append(found[b:e])


def _induce_entries(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in the order that the LMS suffixes in ``seeds`` induce, one entry after the other."""
    n = len(text)
    ends = np.cumsum(np.bincount(text, minlength=k))
    placed = np.full(n, -1, np.int64)
    if len(seeds):
        symbols = text[seeds]
        by = np.argsort(symbols, kind="stable")
        ranked = symbols[by]
        last = np.flatnonzero(np.r_[ranked[1:] != ranked[:-1], True])
        to_go = np.repeat(last, np.diff(np.r_[-1, last])) - np.arange(len(by))
        placed[ends[ranked] - 1 - to_go] = seeds[by]
    array, symbol, up = placed.tolist(), text.tolist(), smaller.tolist()
    head = np.r_[0, ends[:-1]].tolist()
    c = symbol[n - 1]  # the empty suffix comes first of all and induces the last one
    array[head[c]] = n - 1
    head[c] += 1
    for i in range(n):
        j = array[i]
        if j > 0 and not up[j - 1]:
            c = symbol[j - 1]
            array[head[c]] = j - 1
            head[c] += 1
    tail = ends.tolist()
    for i in range(n - 1, -1, -1):
        j = array[i]
        if j > 0 and up[j - 1]:
            c = symbol[j - 1]
            tail[c] -= 1
            array[tail[c]] = j - 1
    return np.array(array, np.int64)


def _induce(text: np.ndarray, smaller: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    """All suffixes in the order that the LMS suffixes in ``seeds`` induce."""
    if len(text) < ENTRIES_A_BUCKET * k:
        return _induce_entries(text, smaller, seeds, k)
    larger: list[list[np.ndarray]] = [[] for _ in range(k)]
    lower: list[list[np.ndarray]] = [[] for _ in range(k)]
    seeded: list[list[np.ndarray]] = [[] for _ in range(k)]
    if len(seeds):
        _dealt(seeds, text[seeds], seeded)
    n = len(text)
    larger[text[n - 1]].append(np.array([n - 1]))  # the empty suffix comes first of all and induces the last one

    def step(now: np.ndarray, c: int, lists: list[list[np.ndarray]], kind: bool) -> np.ndarray:
        """Hand on what the entries ``now`` of bucket c induce; returns those of bucket c itself."""
        before = now[now > 0] - 1
        before = before[smaller[before] == kind]
        symbols = text[before]
        own = symbols == c
        again = before[own]
        if len(again) < len(before):
            _dealt(before[~own], symbols[~own], lists)
        return again

    for c in range(k):
        done = 0
        while done < len(larger[c]):
            now = np.concatenate(larger[c][done:])
            done = len(larger[c])
            if len(again := step(now, c, larger, False)):
                larger[c].append(again)
        if seeded[c]:
            step(np.concatenate(seeded[c]), c, larger, False)
    for c in range(k - 1, -1, -1):  # lists of ``lower`` hold the largest suffix first
        done = 0
        while done < len(lower[c]):
            now = np.concatenate(lower[c][done:])
            done = len(lower[c])
            if len(again := step(now, c, lower, True)):
                lower[c].append(again)
        if larger[c]:
            step(np.concatenate(larger[c])[::-1], c, lower, True)
    out = []
    for c in range(k):
        out += larger[c]
        if lower[c]:
            out.append(np.concatenate(lower[c])[::-1])
    return np.concatenate(out)


def _names(text: np.ndarray, smaller: np.ndarray, order: np.ndarray, lms: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the LMS substrings in text order, equal for equal substrings, in their order; and their number."""
    n = len(text)
    stop = np.full(n + 1, n, np.int64)
    stop[lms[:-1]] = lms[1:]
    a, b = order[:-1], order[1:]
    same = (stop[a] - a == stop[b] - b) & (stop[a] < n) & (stop[b] < n)
    live, off = np.flatnonzero(same), 0
    while len(live):  # symbols equal throughout a substring between two LMS places make its types equal as well
        x, y = a[live], b[live]
        equal = text[x + off] == text[y + off]
        same[live[~equal]] = False
        live = live[equal & (x + off < stop[x])]
        off += 1
    name = np.cumsum(np.r_[0, ~same])
    by_place = np.empty(n, np.int64)
    by_place[order] = name
    return by_place[lms], int(name[-1]) + 1


def suffix_array(text: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of a string over 0..k-1; a suffix that is a prefix of another comes first."""
    text = np.asarray(text)
    if len(text) < 2:
        return np.arange(len(text))
    smaller = _smaller(text)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return _induce(text, smaller, lms, k)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    rough = _induce(text, smaller, lms, k)
    order = rough[is_lms[rough]]
    names, count = _names(text, smaller, order, lms)
    if count < len(lms):
        order = lms[suffix_array(names, count)]
    return _induce(text, smaller, order, k)


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each place in the text, the common prefix of its suffix with the suffix before it in the array.

    A place whose left symbol equals that of its predecessor in the array has one less than the place to its left
    (Kasai's bound is then tight); only the other places are compared, all of them side by side.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    here = np.arange(n)
    shares = (here > 0) & (before > 0)
    shares[shares] = text[here[shares] - 1] == text[before[shares] - 1]
    own = np.flatnonzero(~shares)
    length = np.zeros(n, np.int64)
    live, off = own[before[own] >= 0], 0
    while len(live):
        x, y = live + off, before[live] + off
        inside = np.maximum(x, y) < n
        live, x, y = live[inside], x[inside], y[inside]
        equal = text[x] == text[y]
        live = live[equal]
        off += 1
        length[live] = off
    source = np.maximum.accumulate(np.where(shares, -1, here))
    return np.maximum(length[source] - (here - source), 0)
