from __future__ import annotations

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_repeats import brute

from velograph.llm import op06_toxicity


def tables(path):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [text(n) for n in (15, 30, 50)]
    shared = text(90)
    docs, labels = [], []
    for i in range(260):
        body, toxic = text(rng.randrange(30, 150)), rng.random() < 0.25
        if toxic:
            body += " zorgling blafark" * 4
        elif i % 9 == 0:
            body += " " + rng.choice(items)
        elif i % 11 == 0:
            body += " " + shared + " end"
        elif i % 13 == 0 and docs:
            body = docs[-1][1]
        elif i % 17 == 0 and docs:  # at about 0.8, on both sides
            words = docs[-1][1].split()
            for at in range(rng.randrange(20, 60), len(words), 60):
                words[at] = rng.choice(vocabulary)
            body = " ".join(words)
        docs.append((i, body, "en", ["a", "b", "c", None][i % 4], len(body)))
        labels.append((i, 1, int("zorgling" in body)))
    docs += [(300, None, None, "a", None), (301, "", "en", "b", 0)]
    pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"n_chars": "Int64"}).to_parquet(f"{path}/documents.parquet")
    pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).to_parquet(f"{path}/labels.parquet")
    pd.DataFrame({"item_id": range(3), "text": items}).to_parquet(f"{path}/benchmark.parquet")
    return docs, items


def contaminated(text, items):
    d = re.findall(r"\w+", (text or "").lower())
    for item in items:
        b = item.split()
        for start in range(len(b) - 12):
            if any(sum(0 <= at + j < len(d) and d[at + j] == b[start + j] for j in range(13)) >= 11 for at in range(-12, len(d))):
                return True
    return False


def one_of_each(rows):
    """The first row of each group that Jaccard 0.8 on five words links, by all pairs."""

    def shingles(text):
        words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, root = [shingles(r[1]) for r in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and root[i] != root[j]:
                keep, gone = sorted((root[i], root[j]))
                root = [keep if x == gone else x for x in root]
    return [r for i, r in enumerate(rows) if root[i] == i]


def test_stages_equal_brute_force(spark, tmp_path):
    docs, items = tables(tmp_path)
    d = str(tmp_path)
    read = spark.read.parquet(f"{d}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "mixing"]

    fitted = op06_toxicity.train(read, spark.read.parquet(f"{d}/labels.parquet"))
    score = {r.doc_id: r.score for r in op06_toxicity.toxicity_scores(read, fitted).collect()}
    rows = [r for r in docs if score[r[0]] < corpus_pipeline.TOXIC]
    assert not any("zorgling" in (r[1] or "") for r in rows) and sum("zorgling" not in (r[1] or "") for r in docs) - len(rows) <= 3

    before = len(rows)
    rows = one_of_each(rows)
    assert before - len(rows) > 10

    own = [(r[1] or "").encode() for r in rows]
    cut = [None if r[1] is None else np.frombuffer(b, np.uint8)[~m].tobytes().decode("utf-8", "ignore") for r, b, m in zip(rows, own, brute(own, 200), strict=True)]
    rows = [(r[0], t, r[2], r[3], None if t is None else len(t)) for r, t in zip(rows, cut, strict=True)]
    assert Counter(len(t or "") < len(b) for t, b in zip(cut, own, strict=True))[True] > 3

    rows = [r for r in rows if not contaminated(r[1], items)]
    table = read
    for name in list(stage)[:-1]:
        table = stage[name](spark, table, d)
        assert table.columns == read.columns
    assert sorted(map(tuple, table.collect()), key=str) == sorted(rows, key=str)

    got = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in got} <= {r[0] for r in rows} and sum(r.taken for r in got) > 0
    size = {r[0]: len((r[1] or "").split()) for r in rows}
    assert all(r.size == size[r.doc_id] and r.copies in (1, 2) and r.taken == r.copies * r.size for r in got)


@pytest.mark.parametrize("given", [[], [(i, 1, 0) for i in range(300)], [(i, 1, 1) for i in range(300)]])
def test_without_labels_to_learn_from_all_documents_stay(spark, tmp_path, given):
    docs, _ = tables(tmp_path)
    pd.DataFrame(given, columns=["doc_id", "quality", "toxic"]).astype("int64").to_parquet(f"{tmp_path}/labels.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.toxicity(spark, read, str(tmp_path)).count() == len(docs)


def test_run_on_edge_tables(spark, tmp_path):
    """Null ids and texts, repeated rows, names that stages use themselves, a very long text; then an empty table."""
    docs, _ = tables(tmp_path)
    table = pd.DataFrame(docs, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    odd = pd.DataFrame([(None, docs[3][1] + " more", None, None, 1), (None, None, None, None, None), (5, docs[5][1], "en", "b", 1), (5, "another text of the same id", "en", "b", 1), (400, " ".join(f"long{i}" for i in range(60_000)), "en", "a", 1)], columns=table.columns)
    table = pd.concat([table, table.iloc[:20], odd.astype(table.dtypes.to_dict())]).assign(d=1, h="x", row=2, size=3, label=4, copies=5, fp="y")
    table.to_parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= {*range(302), 400, None} and sum(r.taken for r in got) > 0
    counts = Counter((r.doc_id, r.size) for r in got if r.doc_id is not None)
    assert max(counts.values()) == 1  # repeated rows are near-duplicates
    columns = spark.read.parquet(f"{tmp_path}/documents.parquet").columns
    assert corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).columns == columns
    spark.read.parquet(f"{tmp_path}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/none/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []
