from __future__ import annotations

import random
from itertools import combinations

import corpus_pipeline
import pytest

from velograph.llm.near_copies import drop_near_copies

DOCS = "doc_id long, text string"


def plain_set(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def kept(rows):
    """Ids of the first row of each component over Jaccard similarities of at least 0.8."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    return sorted(r[0] for i, r in enumerate(rows) if find(i) == i)


def texts(bases, copies, edits):
    rng = random.Random(8)
    rows = [(0, None), (1, ""), (2, "One two"), (3, "one TWO")]
    for _ in range(bases):
        n = rng.choice((60, 100, 300))
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        for _ in range(copies):
            own = list(base)
            for at in rng.sample(range(n), rng.randint(0, max(1, n * edits // 100))):
                own[at] = f"v{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(own)))
    return rows


def test_stage_links_all_copies_of_similarity_from_0_8(spark, tmp_path):
    rows = texts(60, 2, 4)
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), str(tmp_path))
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


@pytest.mark.parametrize("limit", [2, 8])
def test_large_buckets_lose_no_link(spark, limit):
    rows = texts(2, 50, 3)
    got = drop_near_copies(spark.createDataFrame(rows, DOCS), bucket_limit=limit)
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)
