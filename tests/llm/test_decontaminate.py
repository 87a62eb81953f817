from __future__ import annotations

import random
import re
from itertools import combinations

import pytest

from velograph.llm.op08_decontaminate import MASKS, contaminated, drop_contaminated

DOCS = "doc_id long, text string, lang string, item_id long, t string, pos int"
ITEMS = "item_id long, text string, doc_id long, seed string"


def tokens(text):
    return re.findall(r"[\u4e00-\u9fff\u3040-\u30ff\u0e01-\u0e30]|[0-9A-Za-zà-ÿÀ-ß]+", (text or "").lower())


def brute(docs, items):
    out = {}
    for doc_id, text, *_ in docs:
        d = tokens(text)
        for item_id, other, *_ in items:
            b = tokens(other)
            if not b:
                continue
            n = min(13, len(b))
            best = 0
            for start in range(len(b) - n + 1):
                for at in range(-n + 1, len(d)):
                    best = max(best, sum(0 <= at + j < len(d) and d[at + j] == b[start + j] for j in range(n)))
            if best >= n - (2 if n == 13 else 1 if n >= 9 else 0):
                out[doc_id, item_id] = (max(best, out.get((doc_id, item_id), (0, 0))[0]), n)
    return out


def test_masks_meet_every_allowed_substitution():
    for window, substituted in ((13, 2), (9, 1)):
        for gone in combinations(range(window), substituted):
            assert any(all(o + i not in gone for i in m) for m in MASKS for o in range(window - m[-1]))


@pytest.mark.parametrize(("limit", "block"), [(250_000, 1), (0, 1_000_000), (0, 60)])
def test_equals_brute_force(spark, limit, block):
    rng = random.Random(11)
    words = ["alpha", "Béta", "gamma", "delta", "x1", "theta"]
    phrase = lambda n: [rng.choice(words) + str(rng.randrange(9)) for _ in range(n)]
    items = [(i, " ".join(phrase(n)), 1, "s") for i, n in enumerate([5, 8, 9, 10, 12, 13, 14, 20, 40])] + [(90, None, 1, "s"), (91, "", 1, "s")]
    items += [(92, items[7][1], 1, "s"), (93, "漢字仮名交文一二三四五六七", 1, "s"), (94, "かな1つ", 1, "s")]
    docs = [(0, None, "x", 1, "t", 1), (1, "", "x", 1, "t", 1), (2, " ... ", "x", 1, "t", 1)]
    for i in range(60):
        part = items[i % 9][1].split()
        b = rng.randrange(0, max(1, len(part) - 12))
        part = part[b : b + rng.choice([11, 12, 13, 14, 60])]
        for _ in range(rng.randrange(4)):
            part[rng.randrange(len(part))] = "changed"
        docs.append((3 + i, " ".join(phrase(rng.randrange(30)) + ["(" + w + ")," for w in part] + phrase(rng.randrange(20))), "x", 1, "t", 1))
    docs += [(80, "abc漢字仮名X文一二三四五六七 and かな1つ", "x", 1, "t", 1), (81, " ".join(phrase(3000)) + " " + items[6][1] + " " + " ".join(phrase(3000)), "x", 1, "t", 1)]
    docs += [docs[10], (None, items[8][1], "x", 1, "t", 1)]
    got = {(r.doc_id, r.item_id): (r.matched, r.window) for r in contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), broadcast_tokens=limit, block_tokens=block).collect()}
    assert got == brute(docs, items) and len(got) > 20


def test_contaminated_documents_go(spark):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)), 1, "s")], ITEMS)
    docs = spark.createDataFrame([(1, "clean text", "x", 1, "t", 1), (2, "see " + " ".join(f"W{i}." for i in range(20)), "x", 1, "t", 1), (None, None, None, None, None, None)], DOCS)
    kept = drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "None"]


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_items_of_every_length_count(spark, monkeypatch, most):
    """The stage drops what the operator reports, with the hashes broadcast or shuffled."""
    from velograph.llm import op08_decontaminate

    monkeypatch.setattr(op08_decontaminate, "BROADCAST_HASHES", most)
    items = spark.createDataFrame([(1, "one two three"), (2, "solo"), (3, " ".join(f"w{i}" for i in range(8))), (4, "")], "item_id long, text string")
    rows = [(1, "say one, TWO three!"), (2, "one two four three"), (3, "so lo"), (4, "a solo b"), (5, " ".join(f"w{i}" for i in range(8))), (6, " ".join(f"w{i}" for i in range(7))), (7, None), (7, ""), (7, "clean")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bad = {r.doc_id for r in contaminated(docs, items).collect()}
    assert bad == {1, 4, 5} and sorted(r.doc_id for r in drop_contaminated(docs, items).collect()) == [2, 3, 6, 7, 7, 7]


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert contaminated(docs, items).count() == 0
    assert contaminated(spark.createDataFrame([(1, "a b", "x", 1, "t", 1)], DOCS), items).count() == 0


def test_runs_of_any_length_are_tokens(spark):
    item = " ".join(f"w{i}" for i in range(15))
    docs = spark.createDataFrame([(1, "x" * 400_000 + " " + item), (2, "漢" * 100_000)], "doc_id long, text string")
    got = contaminated(docs, spark.createDataFrame([(1, item), (2, "漢" * 13)], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.matched) for r in got) == [(1, 1, 13), (2, 2, 13)]
