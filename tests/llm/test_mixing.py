from __future__ import annotations

import random
import re
from fractions import Fraction

from velograph.llm.op03_mixing import mixture, targets

DOCS = "doc_id long, text string, source string, size long, s string, k int"


def plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = Fraction(3, 2) * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        if not open_:
            break
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    return {s: float(2 * sizes[s]) if s in full else float(share[s]) for s in names}


def test_targets_equal_repeated_resharing(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 30):
        sizes = {rng.choice("aZé~") + str(i): rng.choice([0, 1, rng.randrange(1000), rng.randrange(10**6)]) for i in range(n)} | {None: 77}
        rows = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        want = plain_targets(sizes)
        assert {r.source for r in rows} == set(want) and all(abs(r.target - want[r.source]) <= 1e-6 * max(1, want[r.source]) for r in rows)


def test_each_source_comes_near_its_target(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        source = rng.choice(["hot"] * 6 + ["b", "c", "Ä", None])
        rows.append((i if i % 50 else None, None if i % 40 == 0 else " ".join("w" * rng.choice([5, 5, 5, rng.randrange(1, 60)])), source, 1, "x", 2))
    rows += rows[100:110]
    got = mixture(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    size = {}
    for _, text, source, *_ in rows:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(size)
    for source in size:
        own = [r for r in got if r.source == source]
        assert {r.source_size for r in own} == {size[source]}
        assert abs(sum(r.taken for r in own) - want[source]) <= 120
        assert all(r.taken in (0, r.size, 2 * r.size) for r in own)
    again = mixture(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_empty_tables_and_sources_without_words(spark):
    assert mixture(spark.createDataFrame([], DOCS)).count() == 0
    got = mixture(spark.createDataFrame([(1, None, "a", 1, "x", 1), (2, " \n", None, 1, "x", 1)], DOCS)).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2
