from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from velograph.llm import op04_quality, op06_toxicity, op10_language
from velograph.llm.boosting import calibrated, fit_isotonic, fit_trees, margins
from velograph.llm.token_sums import TokenSums, codes_of, grams

DOCS = "doc_id long, text string, lang string, source string, score double, label int"
LABELS = "doc_id long, quality int, toxic int, text string, label int"
EDGE = [(None, "no id here", "en", "s", 0.0, 1), (9001, None, "en", "s", 0.0, 1), (9002, "", None, "s", 0.0, 1), (9003, " \t ", "en", "s", 0.0, 1), (9004, "12 34 !!", "en", None, 0.0, 1), (9005, "word " * 60_000, "en", "s", 0.0, 1), (9005, "word " * 60_000, "en", "s", 0.0, 1)]


def corpus(n=400):
    rng = random.Random(7)
    words = {"en": ["the", "thing", "which", "shall", "with", "wound"], "de": ["schön", "über", "nicht", "zwischen", "und", "ein"], "fr": ["quelle", "était", "où", "français", "leur", "mieux"]}
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(sorted(words))
        body = [rng.choice(words[lang]) + rng.choice(["", "s", "e", ","]) for _ in range(rng.randrange(20, 120))]
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            for _ in range(rng.randrange(2, 6)):
                body.insert(rng.randrange(len(body)), rng.choice(["zorgling", "Zorgmund", "you", "blafark!"]))
        if junk:
            body = [w.upper() + "###" for w in body]
        docs.append((i, " ".join(body), lang, "s", 0.5, 1))
        labels.append((i, 0 if junk else 1, int(toxic), "x", 3))
    return docs + EDGE, labels + [(5, 1, None, "x", 1), (None, 1, 1, "x", 1), (12345, 0, 0, "x", 1)]


def held(doc_id, modulus):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus


def shape(rows, modulus, rest):
    assert len(rows) == 400 + len(EDGE)
    assert all(r.held_out == (held(r.doc_id, modulus) == rest) and 0 <= r.score <= 1 for r in rows)
    return {r.doc_id: r for r in rows}


def test_quality(spark):
    docs, labels = corpus()
    got = shape(op04_quality.quality_scores(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect(), 5, 0)
    own = [(got[i].predicted, q) for i, q, *_ in labels[:400] if held(i, 5) == 0]
    assert np.mean([p == q for p, q in own]) > 0.95 and all(r.predicted == (r.score >= 0.3) for r in got.values())


def test_toxicity(spark):
    docs, labels = corpus()
    d, n = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = op06_toxicity.train(d, n)
    got = shape(op06_toxicity.toxicity_scores(d, model).collect(), 4, 2)
    own = [(got[i].predicted, t) for i, _, t, *_ in labels[:400] if held(i, 4) == 2]
    assert np.mean([p == t for p, t in own]) > 0.95
    kept = op06_toxicity.drop_toxic(d, model, 0.3)
    assert kept.columns == d.columns and kept.count() == sum(not r.predicted for r in got.values()) + 1


def test_toxicity_features():
    lexicon = op06_toxicity.Lexicon(frozenset({"idiot", "lowei-"}), frozenset({"moron"}))
    f = op06_toxicity.Features(lexicon)
    far = "you " + "x " * 40
    texts = [None, "Loweiß!", "id1ot", "you moron", far + "moron", far * 3000 + "you idiot", "CAPS aaa b"]
    x = f.of(texts)
    assert x.shape == (len(texts), op06_toxicity.FEATURES) and not x[0].any()
    assert x[1, 0] == 1 and x[2, 0] == 0 and x[2, 4] == 1 and (x[3, 2], x[3, 7], x[4, 7], x[5, 7]) == (1, 1, 0, 1)
    assert x[6, 9] == pytest.approx(4 / 8) and x[6, 13] == pytest.approx(1 / 3)


def test_language(spark):
    docs, _ = corpus()
    d = spark.createDataFrame(docs, DOCS)
    got = shape(op10_language.languages_of(d, op10_language.train(d)).collect(), 3, 1)
    own = [(got[r[0]].lang_pred, r[2]) for r in docs[:400] if held(r[0], 3) == 1]
    assert np.mean([p == w for p, w in own]) > 0.98
    assert [got[i].lang_pred for i in (9001, 9002, 9003, 9004)] == ["und"] * 4 and got[9001].score == 0 and got[None].lang_pred in ("en", "de", "fr")


def test_many_languages_share_a_filter():
    names = [f"l{i:03d}" for i in range(130)]
    rng = np.random.default_rng(1)
    own = {n: rng.integers(0, 2**63, 50, dtype=np.uint64) for n in names}
    fitted = op10_language.build(names, own, names[0])
    for i, n in enumerate(names):
        found = np.full((50, fitted.masks.shape[1]), np.uint64(2**64 - 1))
        for s in op10_language.slots(own[n], len(fitted.masks)):
            found &= fitted.masks[s]
        assert ((found[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).all()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a text", None, "s", 0.0, 1)], DOCS)
    none, empty = spark.createDataFrame([], LABELS), spark.createDataFrame([], DOCS)
    assert op04_quality.quality_scores(docs, none).first().score == 0.5
    assert op06_toxicity.toxicity_scores(docs, op06_toxicity.train(docs, none)).first().score == 0
    assert op10_language.languages_of(docs, op10_language.train(docs)).first().lang_pred == "und"
    assert op04_quality.quality_scores(empty, none).count() == op06_toxicity.toxicity_scores(empty, op06_toxicity.train(empty, none)).count() == op10_language.languages_of(empty, op10_language.train(empty)).count() == 0


def test_token_sums_forget_and_go_on(monkeypatch):
    from velograph.llm import token_sums

    monkeypatch.setattr(token_sums, "KEPT_TOKENS", 50)
    monkeypatch.setattr(token_sums, "STEP_CHARS", 40)
    own = TokenSums(lambda tokens: np.array([[len(t), 1.0] for t in tokens]), 2)
    rng = random.Random(2)
    texts = [None, "", *[" ".join("w" * rng.randrange(1, 30) + str(rng.randrange(90)) for _ in range(rng.randrange(40))) for _ in range(50)]]
    assert own.sums(texts).tolist() == [[sum(map(len, (t or "").split())), len((t or "").split())] for t in texts]


def test_grams_mark_the_ends_of_words():
    codes, owner = codes_of(["ab", "c"])
    hashes, owners = grams(codes, owner, (2, 3))
    assert len(hashes) == 5 + 3 - 1 + 1 and owners.tolist().count(0) > owners.tolist().count(1)


def test_trees_and_calibration():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 1)).astype(float)
    m = margins(fit_trees(x, y), x)
    assert ((m > 0) == (y > 0)).mean() > 0.97
    places, levels = fit_isotonic(np.array([0.0, 1.0, 2.0, 3.0, 3.0]), np.array([0.0, 1.0, 0.0, 1.0, 0.0]), np.ones(5))
    assert (np.diff(levels) >= 0).all() and calibrated(np.array([-9.0, 9.0]), (places, levels)).tolist() == [0.0, 0.5]


def test_samples_are_the_smallest_hashes(spark):
    from pyspark.sql import functions as F

    from velograph.llm.labelled import first_ids

    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, 1).otherwise(0).alias("y"))
    got = first_ids(rows, F.col("y"), 100).collect()
    hashed = rows.withColumn("o", F.xxhash64("doc_id")).orderBy("o").collect()
    want = {(r.doc_id, y) for y in (0, 1) for r in [h for h in hashed if h.y == y][:100]}
    assert {(r.doc_id, r.label) for r in got} == want


def test_quality_scores_equal_one_feature_after_the_other(spark):
    docs, labels = corpus(60)
    d, n = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = op04_quality.train(d, n)
    got = {(r.doc_id, r.held_out): r.score for r in op04_quality.quality_scores(d, n).collect()}
    for doc_id, text, *_ in docs[:60] + EDGE[:5]:
        tokens = (text or "").split()
        total, count = model.weights[op04_quality.PADDING] * op04_quality.PADDING_TIMES, op04_quality.PADDING_TIMES
        for t in tokens:
            for bucket in op04_quality.features([t])[0].tolist():
                total, count = total + model.weights[bucket], count + 1
        for a, b in zip(tokens, tokens[1:], strict=False):
            if a == b:
                total, count = total + op04_quality.PAIR_TIMES * model.weights[op04_quality.PAIR], count + op04_quality.PAIR_TIMES
        assert got[doc_id, held(doc_id, 5) == 0] == pytest.approx(1 / (1 + np.exp(-(total / count + model.bias))), abs=1e-9)


def test_toxicity_scores_equal_one_text_after_the_other(spark):
    docs, labels = corpus(120)
    d, n = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    model = op06_toxicity.train(d, n)
    got = {r.doc_id: r.score for r in op06_toxicity.toxicity_scores(d, model).collect()}
    first, second = model.lexicon
    for doc_id, text, *_ in docs[:120]:
        tokens = (text or "").split()
        found = [op06_toxicity.units(t) for t in tokens]
        x = op06_toxicity.Features(model.lexicon).of([text])[0]
        assert (x[0], x[2]) == (sum(bool(u & first) for u in found), sum(bool(u & second) for u in found))
        assert x[9] == pytest.approx(sum(c.isupper() for t in tokens for c in t) / max(1, sum(c.isalpha() for t in tokens for c in t)))
        assert got[doc_id] == pytest.approx(float(calibrated(margins(model.trees, x[None, :]), model.curve)[0]), abs=1e-9)


def test_lexicon_counts_equal_brute_force(spark, monkeypatch):
    docs, labels = corpus(200)
    toxic = {i: t for i, _, t, *_ in labels[:200]}
    rows = [(i, text, toxic[i]) for i, text, *_ in docs[:200] if held(i, 4) != 2]
    a = [u for _, text, y in rows if y for u in set().union(*(op06_toxicity.units(t) for t in text.split()))]
    b = [u for _, text, y in rows if not y for u in set().union(*(op06_toxicity.units(t) for t in text.split()))]
    from collections import Counter

    want = op06_toxicity.learn_lexicon(Counter(a), Counter(b), sum(y for *_, y in rows), sum(not y for *_, y in rows), op06_toxicity.SETTINGS[1])
    monkeypatch.setattr(op06_toxicity, "SETTINGS", op06_toxicity.SETTINGS[1:2])
    got = op06_toxicity.train(spark.createDataFrame(docs[:200], DOCS), spark.createDataFrame(labels[:200], LABELS)).lexicon
    assert got == want and any("zorg" in u for u in got.first | got.second)


def test_words_that_differ_late_are_different():
    long = "x" * 80
    known = op06_toxicity.Features(op06_toxicity.Lexicon(frozenset({long + "a"}), frozenset()))
    assert known.of([long + "a", long + "b"])[:, 0].tolist() == [1, 0]


def test_languages_equal_sets_of_grams(spark):
    docs, _ = corpus(150)
    d = spark.createDataFrame(docs, DOCS)
    fitted = op10_language.train(d)
    sets = {}
    for lang in fitted.languages:
        own = [text for i, text, where, *_ in docs if where == lang and text is not None and held(i, 3) != 1]
        counts = {}
        for text in own:
            for g in set(op10_language.token_grams(sorted(set(text.split())))[0].tolist()) if text.split() else ():
                counts[g] = counts.get(g, 0) + 1
        sets[lang] = {g for g, n in counts.items() if n >= (2 if len(own) >= 20 else 1)}
    got = {r.doc_id: r.lang_pred for r in op10_language.languages_of(d, fitted).collect()}
    for doc_id, text, *_ in docs[:150]:
        votes = {lang: sum(g in own for t in text.split() for g in op10_language.token_grams([t])[0].tolist()) for lang, own in sets.items()}
        best = max(votes.values())
        assert got[doc_id] in {lang for lang, n in votes.items() if n >= best - 1}


@pytest.mark.parametrize("labelled", [[], [0] * 40, [1] * 40, [0, 1, 1, 1, 1, 1], [0, 1] * 20])
def test_nothing_learned_rejects_nothing(spark, labelled):
    """No labels, one class, too few of them, or texts that labels have nothing to do with."""
    docs = spark.createDataFrame([(i, "same words in every text", None, "s", 0.0, 1) for i in range(60)], DOCS)
    labels = spark.createDataFrame([(i, 1, y, "x", 1) for i, y in enumerate(labelled)], LABELS)
    model = op06_toxicity.train(docs, labels)
    assert op06_toxicity.drop_toxic(docs, model).count() == 60
    assert {(r.score, r.predicted) for r in op06_toxicity.toxicity_scores(docs, model).collect()} == {(0.0, 0)}


def test_held_out_labels_change_nothing(spark):
    """The model is the same whatever the labels of held-out documents say: settings are chosen by the others."""
    docs, labels = corpus(200)
    other = [(i, q, 1 - t if t is not None and held(i, 4) == 2 else t, *rest) for i, q, t, *rest in labels]
    d = spark.createDataFrame(docs, DOCS)
    one, two = (op06_toxicity.train(d, spark.createDataFrame(x, LABELS)) for x in (labels, other))
    assert one.lexicon == two.lexicon and all((a == b).all() for a, b in zip(one.trees[:3], two.trees[:3], strict=True))
    assert (one.curve[0] == two.curve[0]).all() and (one.curve[1] == two.curve[1]).all()


def test_trees_equal_plain_ones():
    """Against a trainer that tries every bound of every feature in loops."""
    rng = np.random.default_rng(7)
    x, rate, shrink, least = rng.integers(0, 6, size=(120, 3)).astype(float), 0.3, 1.0, 5
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3)).astype(float)
    got = margins(fit_trees(x, y, trees=4, depth=2, rate=rate, shrink=shrink, least=least), x)
    share = (y.sum() + 0.5) / (len(y) + 1)
    score = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(4):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)

        def grow(rows, depth):
            best = (1e-6, None)
            if depth < 2 and len(rows) >= 2 * least:
                for f in range(3):
                    for bound in sorted(set(x[:, f]))[:-1]:
                        left, right = rows[x[rows, f] <= bound], rows[x[rows, f] > bound]
                        if min(len(left), len(right)) >= least:
                            gain = sum(g[r].sum() ** 2 / (h[r].sum() + shrink) for r in (left, right)) - g[rows].sum() ** 2 / (h[rows].sum() + shrink)
                            if gain > best[0] + 1e-12:
                                best = (gain, (left, right))
            if best[1] is None:
                score[rows] += -rate * g[rows].sum() / (h[rows].sum() + shrink)
            else:
                for side in best[1]:
                    grow(side, depth + 1)

        grow(np.arange(len(y)), 0)
    assert np.allclose(got, score)
