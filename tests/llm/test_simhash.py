from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import xxhash

from velograph.llm.op05_simhash import BITS, covering_masks, drop_near_duplicates, fingerprint_links, simhash_components
from velograph.llm.simhash_kernel import majority_bits, shingle_hashes
from velograph.operators.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps, radius=4):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(ids)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= radius:
            root[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        least[find(i)] = min(least.get(find(i), x), x)
    return {x: least[find(i)] for i, x in enumerate(ids)}


def test_every_set_of_bits_in_the_radius_is_missed_by_a_mask():
    masks, rng = covering_masks(4), random.Random(1)
    for _ in range(5000):
        bits = sum(1 << i for i in rng.sample(range(BITS), 4))
        assert any(not m & bits for m in masks)


def test_fingerprint_of_long_and_short_texts():
    for text in (None, "", " \t\n", "One", "one TWO three", "a b c d e", "É É É É é", "w " * 70000, "x y z\x1f q r s"):
        assert majority_bits(shingle_hashes(text)) == plain_fingerprint(text), text


def test_components_equal_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = [None, "", "  ", "same text here", "same text here"]
    for _ in range(30):
        base = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        for _ in range(rng.randint(1, 4)):
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
            texts.append(" ".join(own))
    rows = [(i + 10, t, None, None, None, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash_components(spark.createDataFrame(rows, DOCS)).collect()}
    fps = [plain_fingerprint(t) for t in texts]
    want = plain_components([r[0] for r in rows], fps)
    assert {k: v[1] for k, v in got.items()} == want
    assert [got[r[0]][0] % 2**64 for r in rows] == fps


def test_large_buckets_keep_every_link(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    fps = sorted({b ^ sum(1 << int(i) for i in rng.choice(63, rng.integers(0, 5))) for b in base for _ in range(60)})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    for limit in (2, 16, 256):
        found = {r.node: r.component for r in connected_components(fingerprint_links(frame, 4, limit)).collect()}
        want = plain_components(fps, fps)
        assert {x: found.get(x, x) for x in fps} == want, limit


def test_empty_table_and_null_ids(spark):
    assert simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c d e", None, None, None, None), (4, "a b c d e", None, None, None, None), (9, None, "x", None, 0, None), (None, None, None, None, None, None)]
    got = sorted(((r.doc_id, r.component_id) for r in simhash_components(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == [(4, 4), (9, 9), (None, 4), (None, 9)]


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d e f", "en", "s", 1, "k"), (2, "a b c d e f", "en", "s", 1, "k"), (2, "a b c d e f", "en", "s", 1, "k"), (3, "q r s t u v w x y z", "en", None, 1, "k"), (3, "q r s t u v w x y z", "en", None, 1, "k")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3] and kept.columns == [c.split()[0] for c in DOCS.split(", ")]
    rows += [(None, t, "en", None, 1, "k") for t in ("a b c d e f", "h i j k l m n o p", "h i j k l m n o p", "one two three four five six")] + [(3, "another text with this id again", "en", None, 1, "k")]
    kept = drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [(1, "a b c d e f"), (3, "q r s t u v w x y z"), (None, "h i j k l m n o p"), (None, "one two three four five six"), (3, "another text with this id again")]))
