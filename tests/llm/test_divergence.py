"""Operator 11 against a plain loop over all pairs of groups."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from velograph.llm.op11_divergence import TERM, UNIT, counted_terms, divergence, share, shares

SCHEMA = "doc_id long, text string, lang string, source string"


def plain(rows, least_docs, top, prior=5):
    """By whole numbers of any size."""
    uses, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(TERM, low)
        uses[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = set()
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least_docs)
        groups = {s: u for (g, s), u in uses.items() if g == lang}
        total = {t: sum(u[t] for u in groups.values()) for t in kept}

        def p(count):
            n = sum(count[t] for t in kept) + prior * len(kept)
            return {t: 1 + UNIT * (count[t] + prior) // n for t in kept}

        q, own = p(total), {s: p(u) for s, u in groups.items()}
        for s in groups:
            apart = sorted((-sum(abs(own[s][t] - own[o][t]) for t in kept), o.encode(), o) for o in groups if o != s)
            out |= {(lang, s, "pair", o, -v, i + 1) for i, (v, _, o) in enumerate(apart)}
            more = sorted((q[t] - own[s][t], t.encode(), t) for t in kept if groups[s][t] and own[s][t] > q[t])
            out |= {(lang, s, "term", t, -v, i + 1) for i, (v, _, t) in enumerate(more[:top])}
    return out


def texts(n, seed):
    draw = random.Random(seed)
    words = [f"{a}{b}" for a in ("Ab", "cé", "ß", "语言", "x", "ÀB", "é", "🙂") for b in ("", "a", "Z", "ñ", "q")]
    langs, sources = ["en", "de", None, ""], [None, "", "web", "Web", "books", "ﬁ", "🙂", "forum"]
    return [(i, " ".join(draw.choices(words, weights=range(1, len(words) + 1), k=draw.randint(0, 12))) if draw.random() > 0.1 else draw.choice([None, "", "12 34 --"]), draw.choice(langs), draw.choice(sources)) for i in range(n)]


@pytest.mark.parametrize("sizes", [{}, {"chunk": 4, "block": 2, "stripe": 3}, {"chunk": 1, "block": 1, "stripe": 1}])
def test_equal_to_a_loop_over_pairs(spark, sizes):
    rows = texts(250, 3)
    rows += [rows[7]] * 5 + [(None, "ab ab Ab", "fr", "one"), (9, None, "it", "a"), (9, "17", "it", "b"), (9, "rare words", "it", "c")]
    rows += [(1, "cé0cé_cé" * 30_000, "de", "long")]
    got = [tuple(r) for r in divergence(spark.createDataFrame(rows, SCHEMA), least_docs=5, top=4, **sizes).collect()]
    want = plain(rows, 5, 4)
    assert set(got) == want and len(got) == len(want)
    assert ("it", "a", "pair", "b", 0, 1) in want  # no kept term
    assert not [r for r in want if r[0] == "fr"]  # one source, no kept term


def test_clashing_and_missing_values(spark):
    rows = [(i, "alpha beta", "en", "s") for i in range(3)] + [(i, "alpha gamma", "en", "t") for i in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    extra = docs
    for name in ("term", "n", "docs", "block", "g", "value", "item", "rank", "total", "at"):
        extra = extra.withColumn(name, F.lit("x"))
    assert sorted(map(tuple, divergence(extra, least_docs=3).collect())) == sorted(plain(rows, 3, 50))
    empty = divergence(docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["lang", "source", "part", "item", "value", "rank"]
    nothing = docs.select(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"))
    assert divergence(nothing).collect() == []


def test_counts_of_terms(spark):
    rows = [(1, "A a\x00b É é", "en", "s"), (2, "a", "en", "s"), (3, None, "en", "s"), (4, "", None, None)]
    got = {tuple(r) for r in counted_terms(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {("en", "s", "a", 3, 2), ("en", "s", "b", 1, 1), ("en", "s", "É", 1, 1), ("en", "s", "é", 1, 1), ("en", "s", "", 3, 3), ("", "", "", 1, 1)}


def test_shares_are_exact_for_large_counts(spark):
    counts = [0, 1, 7, 10**9, 4 * 10**12, 123_456_789_012_345]
    total = sum(counts) + 5 * len(counts)
    want = [1 + UNIT * (c + 5) // total for c in counts]
    assert shares(np.array([counts]), np.array([total]))[0].tolist() == want
    got = spark.createDataFrame([(c, total) for c in counts], "c long, t long").select(share(F.col("c"), F.col("t"))).collect()
    assert [r[0] for r in got] == want
