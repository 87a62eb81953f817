from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from velograph.llm import repeats
from velograph.llm.op07_suffix import digest_removed, without_repeats
from velograph.llm.op09_extend import digest_removed_words
from velograph.llm.suffix_kernel import permuted_lcp, suffix_array

DOCS = "doc_id long, text string, lang string, source string, n_chars long, m long, h long, spans string"


def brute(sequences, window):
    starts = Counter(tuple(s[i : i + window]) if not isinstance(s, bytes) else s[i : i + window] for s in sequences for i in range(len(s) - window + 1))
    masks = []
    for s in sequences:
        mask = np.zeros(len(s), bool)
        for i in range(len(s) - window + 1):
            if starts[s[i : i + window] if isinstance(s, bytes) else tuple(s[i : i + window])] > 1:
                mask[i : i + window] = True
        masks.append(mask)
    return masks


def brute_bytes(rows, window=200):
    own = [(r[1] or "").encode() for r in rows]
    out = []
    for r, s, mask in zip(rows, own, brute(own, window), strict=True):
        kept = bytes(b for b, g in zip(s, mask, strict=True) if not g)
        out.append((r[0], len(s), int(mask.sum()), sum(mask[i] and (i == 0 or not mask[i - 1]) for i in range(len(s))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def brute_words(rows, window=35):
    own = [(r[1] or "").encode().split() for r in rows]
    out = []
    for r, s, mask in zip(rows, own, brute(own, window), strict=True):
        kept = b" ".join(w for w, g in zip(s, mask, strict=True) if not g)
        out.append((r[0], len(s), int(mask.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["alpha", "béta", "gamma", "δ", "eps\x1f", " zeta", "eta x", "THETA", "iota", "k"]
    phrase = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    shared = [phrase(n) for n in (34, 35, 36, 60, 120)]
    texts = [None, "", " \t\n", "short", "a" * 450, "ab" * 300, "abc " * 300, "x" * 199, "x" * 200]
    for i in range(60):
        parts = [phrase(rng.randrange(1, 60))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), phrase(rng.randrange(1, 30))]
        texts.append(" ".join(parts))
        if i % 7 == 0:
            texts.append(texts[-1])  # exact copy
        if i % 5 == 0:
            near = texts[-1].split(" ")
            near[len(near) // 2] = "changed"
            texts.append("  ".join(near) if i % 2 else " ".join(near))
    rows = [(i, t, None, None, None, 1, 2, "s") for i, t in enumerate(texts)]
    rows += [rows[12], (None, "nobody " + shared[3], None, None, None, 1, 2, "s"), (None, "no one " + shared[4], None, None, None, 1, 2, "s"), (5, "same id " + shared[2], None, None, None, 1, 2, "s")]
    return rows


@pytest.mark.parametrize("limit", [2_000, 3, 1])
def test_bytes_equal_brute_force(spark, limit):
    rows = corpus(limit)
    got = digest_removed(spark.createDataFrame(rows, DOCS), key_contents=limit)
    assert sorted(map(tuple, got.collect()), key=str) == brute_bytes(rows)


@pytest.mark.parametrize("limit", [2_000, 3, 1])
def test_words_equal_brute_force(spark, limit):
    rows = corpus(limit + 1)
    got = digest_removed_words(spark.createDataFrame(rows, DOCS), key_contents=limit)
    assert sorted(map(tuple, got.collect()), key=str) == brute_words(rows)


def test_long_texts_are_cut_into_blocks_without_loss(spark, monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1024)  # in this process; the kernel is called directly
    unit_rows = corpus(9)
    texts = [r[1] for r in unit_rows] + ["".join(random.Random(i).choices("abcdefgh ", k=5000)) for i in range(3)]
    from velograph.llm.op07_suffix import byte_unit
    from velograph.llm.winnow_kernel import runs_of

    unit = byte_unit()
    seen = Counter()
    for held, symbols, lengths in repeats._blocks(texts, texts, unit):
        runs = runs_of(unit.hashes(symbols), lengths, unit.window, unit.k)
        base = np.cumsum(lengths) - lengths
        for doc, first, count in zip(runs.doc, runs.first, runs.count, strict=True):
            row, offset = held[doc]
            seen.update((row, int(first - base[doc] + offset + i)) for i in range(count))
    want = {(i, p) for i, t in enumerate(texts) for p in range(len((t or "").encode()) - 199)}
    assert set(seen) == want and max(seen.values()) == 1


def test_suffix_arrays_and_prefixes():
    rng = random.Random(1)
    for t in range(300):
        k = rng.choice([2, 3, 4, 10, 257])
        x = [rng.randrange(k) for _ in range(rng.randint(1, 60))] * (3 if t % 3 == 0 else 1)
        array = suffix_array(np.array(x, np.uint16), k)
        want = sorted(range(len(x)), key=lambda i: x[i:])
        assert array.tolist() == want
        left = permuted_lcp(np.array(x, np.uint16), array)
        for a, b in zip(want, want[1:], strict=False):
            shared = 0
            while max(a, b) + shared < len(x) and x[a + shared] == x[b + shared]:
                shared += 1
            assert left[b] == shared


def test_texts_without_their_repeats(spark):
    rows = corpus(4)
    kept = without_repeats(spark.createDataFrame(rows, DOCS))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() == len(rows)
    masks = brute([(r[1] or "").encode() for r in rows], 200)
    want = sorted(str((r[0], None if r[1] is None else bytes(b for b, g in zip(r[1].encode(), m, strict=True) if not g).decode("utf-8", "ignore"))) for r, m in zip(rows, masks, strict=True))
    assert sorted(str((r.doc_id, r.text)) for r in kept.collect()) == want


def test_empty_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert digest_removed(empty).count() == digest_removed_words(empty).count() == without_repeats(empty).count() == 0
