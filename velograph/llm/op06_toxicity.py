"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The lexicon is learned: words and word beginnings that are found in far more toxic than other documents, in two
tiers by how sure that is.  A document's features are densities of both tiers (also of words read through digits and
signs put for letters), how many entries it has in all, how near they stand to a second-person pronoun, and its rates
of capitals, punctuation, obfuscated words and stretched letters.  Everything but the distances adds up over tokens.

The labelled sample is split into folds by id.  A document's features come from a lexicon made without its fold, and
the calibration from the margins of trees grown without its fold, so both see documents as unseen ones will be.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm.boosting import Trees, calibrated, fit_isotonic, fit_trees, margins
from velograph.llm.labelled import labelled_sample
from velograph.llm.tables import crc_remainder, table
from velograph.llm.token_sums import TokenSums, codes_of
from velograph.plans.materialize import materialize, release

#: Labelled documents of a class that are learned from, at most.  They bound the lexicon, which has no size of its own.
PER_CLASS = 4_000
class Setting(NamedTuple):
    """How a lexicon is learned: bounds of the log ratio from which a unit is in the first tier or the second, the standard
    errors that are taken off before, and the least toxic documents that have a unit."""

    bounds: tuple[float, float]
    errors: float
    least: int


#: The settings tried; the one with the least cross-fitted loss on the learning rows is used.
SETTINGS = (Setting((2.0, 1.0), 2.6, 4), Setting((1.5, 0.5), 2.0, 4), Setting((1.0, 0.25), 2.0, 3))
#: Lengths of word beginnings that can be entries.
STEMS = (4, 5, 6)
#: Words on either side in which a pronoun counts as near.
NEAR = 5
#: Parts of the sample for cross-fitting.
FOLDS = 4
THRESHOLD = 0.3
#: The curve of a model that has learned nothing.
NOTHING = (np.zeros(1), np.zeros(1))
MODULUS, HELD = 4, 2
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta vous votre vos tú ti usted ustedes vosotros".split())
_WORD = re.compile(r"[^\W\d_]+")
_DISGUISE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": ""})
#: Numbers of a token that add up: tier 1 and 2, tier 1 and 2 once undisguised, pronoun, letters, capitals, marks, ! or ?, obfuscated, stretched, one.
_T1, _T2, _D1, _D2, _YOU, _LETTERS, _CAPITALS, _MARKS, _CALLS, _MIX, _LONG, _ONE = range(12)
WIDTH = 12
#: Features of a text.
FEATURES = 15


class Lexicon(NamedTuple):
    first: frozenset[str]
    second: frozenset[str]


class Model(NamedTuple):
    lexicon: Lexicon
    trees: Trees
    curve: tuple[np.ndarray, np.ndarray]


def units(token: str) -> set[str]:
    """What of a token can be an entry: its words, and their beginnings marked by a hyphen."""
    out = set()
    for word in _WORD.findall(token.lower()):
        out.add(word)
        out |= {word[:n] + "-" for n in STEMS if len(word) >= n}
    return out


def learn_lexicon(toxic: Counter, other: Counter, n_toxic: int, n_other: int, setting: Setting) -> Lexicon:
    """Tiers by the lower bound of the log ratio of document shares."""
    scored = []
    for unit, a in toxic.items():
        b = other.get(unit, 0)
        if a < setting.least:
            continue
        ratio = np.log((a + 0.5) / (n_toxic + 1)) - np.log((b + 0.5) / (n_other + 1))
        bound = ratio - setting.errors * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) - 1 / (n_toxic + 1) - 1 / (n_other + 1))
        if bound > setting.bounds[1]:
            scored.append((-bound, -a, unit))
    names = [u for *_, u in sorted(scored)]
    cut = sum(-s > setting.bounds[0] for s, *_ in scored)
    return Lexicon(frozenset(names[:cut]), frozenset(names[cut:]))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))


class Hashes:
    """A lexicon as sorted hashes of words and of beginnings, to look up many at once."""

    def __init__(self, lexicon: Lexicon):
        self.tiers = [{n: self._of(tier, n) for n in (0, *STEMS)} for tier in lexicon]
        self.you = self._of(SECOND_PERSON, 0)

    @staticmethod
    def _of(entries: frozenset[str], stem: int) -> np.ndarray:
        own = [e[:-1] for e in entries if e.endswith("-") and len(e) == stem + 1] if stem else [e for e in entries if not e.endswith("-")]
        if not own:
            return np.empty(0, np.uint64)
        codes, _ = codes_of(own)
        return np.sort(_hash(_prefixes(codes), *runs_of_letters(codes)))

    @staticmethod
    def has(known: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(known):
            return np.zeros(len(hashes), bool)
        return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes


def runs_of_letters(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of each run of codes other than zero; the array begins and ends with a zero."""
    filled = codes != 0
    begin = np.flatnonzero(filled[1:] & ~filled[:-1]) + 1
    return begin, np.flatnonzero(filled[:-1] & ~filled[1:]) + 1 - begin


def _prefixes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the codes before each place, each by a falling power, and the rising powers that undo this."""
    with np.errstate(over="ignore"):
        falling, rising = (np.r_[np.uint64(1), np.cumprod(np.full(len(codes), x))] for x in (_INVERSE, _BASE))
        return np.r_[np.uint64(0), np.cumsum(codes.astype(np.uint64) * falling[1:])], rising


def _hash(prefixes: tuple[np.ndarray, np.ndarray], begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A polynomial hash of ``length`` codes from ``begin`` on, whole words of any length at once."""
    sums, rising = prefixes
    with np.errstate(over="ignore"):
        out = (sums[begin + length] - sums[begin]) * rising[begin] + length.astype(np.uint64) * _BASE
        return out ^ (out >> np.uint64(29))


@lru_cache(maxsize=1)
def kinds() -> dict[str, np.ndarray]:
    """What each code point is."""
    every = [chr(c) for c in range(0x110000)]
    letter, upper = np.array([c.isalpha() for c in every]), np.array([c.isupper() for c in every])
    return {"letter": letter, "upper": upper, "mark": np.array([not c.isalnum() for c in every]), "hides": np.array([c.isdecimal() or c in "@$!*._-" for c in every])}


def _tiers(prefixes: tuple[np.ndarray, np.ndarray], owner: np.ndarray, begin: np.ndarray, length: np.ndarray, whole: np.ndarray, known: Hashes, n: int) -> list[np.ndarray]:
    """For each tier, which of ``n`` tokens hold an entry."""
    stems = {s: _hash(prefixes, begin, np.minimum(length, s)) for s in STEMS}
    out = []
    for tier in known.tiers:
        hit = Hashes.has(tier[0], whole)
        for s in STEMS:
            hit |= (length >= s) & Hashes.has(tier[s], stems[s])
        out.append(np.bincount(owner[begin], hit, n) > 0)
    return out


def token_numbers(tokens: list[str], known: Hashes) -> np.ndarray:
    n, kind = len(tokens), kinds()
    out = np.zeros((n, WIDTH))
    count = lambda owner, what: np.bincount(owner, what, n)
    # lower case: words and their beginnings
    codes, owner = codes_of([t.lower() for t in tokens], kind["letter"])
    begin, length = runs_of_letters(codes)
    prefixes = _prefixes(codes)
    whole = _hash(prefixes, begin, length)
    out[:, _T1], out[:, _T2] = _tiers(prefixes, owner, begin, length, whole, known, n)
    out[:, _YOU] = count(owner[begin], Hashes.has(known.you, whole)) > 0
    # as written: kinds of characters; the zero before each token is of no kind
    codes, owner = codes_of(tokens)
    real = codes != 0
    letter, hides = kind["letter"][codes], kind["hides"][codes] & real
    out[:, _LETTERS], out[:, _CAPITALS], out[:, _MARKS] = (count(owner, x) for x in (letter, kind["upper"][codes], kind["mark"][codes] & real))
    out[:, _CALLS], out[:, _ONE] = count(owner, (codes == 33) | (codes == 63)), 1
    out[:, _LONG] = count(owner[1:-1], letter[1:-1] & (codes[1:-1] == codes[:-2]) & (codes[1:-1] == codes[2:])) > 0
    first = np.flatnonzero(hides[1:] & letter[:-1]) + 1  # runs of digits and signs between letters
    last = np.flatnonzero(hides[:-1] & ~hides[1:])
    after = last[np.searchsorted(last, first)] + 1 if len(first) else first
    out[:, _MIX] = count(owner[first], letter[after]) > 0 if len(first) else 0
    out[:, _D1], out[:, _D2] = out[:, _T1], out[:, _T2]
    hidden = np.flatnonzero(out[:, _MIX])
    if len(hidden):
        shown, own = codes_of([tokens[i].translate(_DISGUISE).lower() for i in hidden], kind["letter"])
        begin, length = runs_of_letters(shown)
        prefixes = _prefixes(shown)
        out[hidden, _D1], out[hidden, _D2] = _tiers(prefixes, own, begin, length, _hash(prefixes, begin, length), known, len(hidden))
    return out


class Features:
    """Dense features of texts for one lexicon."""

    def __init__(self, lexicon: Lexicon):
        known = Hashes(lexicon)
        self.own = TokenSums(lambda tokens: token_numbers(tokens, known), WIDTH)

    def near(self, text: str | None) -> float:
        """Tokens with an entry that have a second-person pronoun within ``NEAR`` tokens."""
        tokens = text.split() if text else []
        count, step = 0.0, 50_000
        for at in range(0, len(tokens), step):
            first = max(0, at - NEAR)
            columns = self.own.columns_of(tokens[first : at + step + NEAR])
            said = np.r_[0, np.cumsum(columns[_YOU])]
            place = np.arange(len(said) - 1)
            you = said[np.minimum(place + NEAR + 1, len(place))] - said[np.maximum(place - NEAR, 0)]
            hit = (columns[_D1] + columns[_D2] > 0) & (you > 0)
            count += hit[at - first : at - first + min(step, len(tokens) - at)].sum()
        return count

    def of(self, texts: list[str | None]) -> np.ndarray:
        s = self.own.sums(texts)
        hits = s[:, _D1] + s[:, _D2]
        near = np.zeros(len(texts))
        for i in np.flatnonzero((hits > 0) & (s[:, _YOU] > 0)):
            near[i] = self.near(texts[i])
        tokens, letters = np.maximum(s[:, _ONE], 1), np.maximum(s[:, _LETTERS], 1)
        return np.stack([
            s[:, _T1], s[:, _T1] / tokens, s[:, _T2], s[:, _T2] / tokens, s[:, _D1], s[:, _D1] / tokens, hits / np.sqrt(tokens), near, near / np.maximum(hits, 1),
            s[:, _CAPITALS] / letters, s[:, _MARKS] / tokens, s[:, _CALLS] / tokens, s[:, _MIX] / tokens, s[:, _LONG] / tokens, np.log1p(s[:, _ONE]),
        ], axis=1)


def _fold(doc_id: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id).encode(), 6) % FOLDS


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of ``labels.toxic``, from at most ``per_class`` documents a class whose ids are not held out.

    The sample is written once and read twice.  What comes to the driver is bounded by it: counts of units found in
    ``least`` toxic documents or more, then a row of features for each sampled document and setting.  Of the settings the
    one is used whose trees, grown without a document's fold, have the least loss on it; held-out labels play no part.

    Where there is nothing to learn from, as without labels, with labels of one class, or too few for a single split, no
    document is known to be toxic and all scores are 0.
    """
    sample = materialize(labelled_sample(docs, labels, "toxic", MODULUS, HELD, per_class), "toxic-sample")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, label, text in zip(batch["doc_id"], batch["label"], batch["text"], strict=True):
                found = {""}.union(*(units(t) for t in set((text or "").split())))
                yield pd.DataFrame({"unit": sorted(found), "fold": _fold(doc_id), "a": int(label), "b": 1 - int(label)})

    parts = sample.mapInPandas(count, "unit string, fold int, a long, b long").groupBy("unit").agg(
        F.sum("a").alias("total"), *[F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(FOLDS) for c in "ab"]
    )
    least = min(s.least for s in SETTINGS)
    seen = parts.where((F.col("total") >= least) | (F.col("unit") == "")).toPandas().sort_values("unit").set_index("unit")

    def lexicon_without(fold: int | None, setting: Setting) -> Lexicon:
        a, b = (sum(seen[f"{c}{k}"] for k in range(FOLDS) if k != fold) for c in "ab")
        return learn_lexicon(Counter(a.drop("", errors="ignore").to_dict()), Counter(b.to_dict()), int(a.get("", 0)), int(b.get("", 0)), setting)

    lexicons = [[lexicon_without(k, s) for k in range(FOLDS)] for s in SETTINGS]

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [[Features(x) for x in folds] for folds in lexicons]
        for batch in batches:
            for k, part in batch.groupby(batch["doc_id"].map(_fold)):
                x = np.concatenate([folds[k].of(part["text"].tolist()) for folds in own], axis=1)
                yield pd.DataFrame({"doc_id": part["doc_id"], "label": part["label"].astype("int32"), "x": list(x)})

    rows = sample.mapInPandas(describe, "doc_id long, label int, x array<double>").toPandas()
    release(sample)
    if rows["label"].nunique() < 2:
        return Model(Lexicon(frozenset(), frozenset()), fit_trees(np.zeros((0, FEATURES)), np.zeros(0)), NOTHING)
    # equal ids are ordered by their features, so that the fit does not depend on the order of rows
    rows = rows.assign(_x=rows["x"].map(tuple)).sort_values(["doc_id", "label", "_x"], kind="stable")
    every = np.stack(rows["x"].tolist()).reshape(len(rows), len(SETTINGS), FEATURES)
    y, fold = rows["label"].to_numpy(float), np.array([_fold(d) for d in rows["doc_id"]], int)
    tried = [_crossed(every[:, i], y, fold) for i in range(len(SETTINGS))]
    best = int(np.argmin([_loss(margin, y) for margin in tried]))
    trees = fit_trees(every[:, best], y)
    if (trees.feature < 0).all():
        return Model(Lexicon(frozenset(), frozenset()), trees, NOTHING)
    share = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), MODULUS) != HELD)).agg(F.avg("toxic")).first()[0]
    return Model(lexicon_without(None, SETTINGS[best]), trees, fit_isotonic(tried[best], y, _weights(y, share)))


def _crossed(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> np.ndarray:
    """Margins of trees grown without the row's fold."""
    out = np.zeros(len(y))
    for k in np.unique(fold):
        out[fold == k] = margins(fit_trees(x[fold != k], y[fold != k]), x[fold == k])
    return out


def _loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(y == 1, -margin, margin)).mean())


def _weights(y: np.ndarray, share: float | None) -> np.ndarray:
    """Weights with which class 1 has its share of the labels; the sample may hold less of the commoner class."""
    have = y.mean() if len(y) else 0.0
    if share is None or not 0 < share < 1 or not 0 < have < 1:
        return np.ones(len(y))
    return np.where(y == 1, share / have, (1 - share) / (1 - have))


def toxicity_scores(docs: DataFrame, fitted: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have all features zero and a score like any other.  Texts and words count whole, however
    long.  Equal texts have equal scores.  Ids may be null (hashed as the
    empty string) or repeated.  Where ``train`` had nothing to
    learn from, all scores are 0.  An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon, trees, curve = model.value
        own = Features(lexicon)
        for batch in batches:
            score = calibrated(margins(trees, own.of(batch["text"].tolist())), curve)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": score, "predicted": (score >= threshold).astype("int32")})

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), "text", (crc_remainder(doc_id, MODULUS) == HELD).alias("held_out")).mapInPandas(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, fitted: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores under ``threshold``, all columns kept; one pass and no shuffle.

    The text alone decides: a null text scores as an empty one, repeated rows stay or go together, ids do not matter.  Where
    ``train`` had nothing to learn from, all rows stay.  An empty table gives an empty result.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon, trees, curve = model.value
        own = Features(lexicon)
        for batch in batches:
            yield pd.Series(calibrated(margins(trees, own.of(batch.tolist())), curve))

    return docs.where(score("text") < threshold)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document; nulls, repeats and long texts as ``toxicity_scores`` says."""
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))
