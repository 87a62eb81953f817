from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from velograph.llm import op01_forest
from velograph.llm.op01_forest import nearest


def test_candidates_grow_until_recall_is_enough(spark, monkeypatch):
    monkeypatch.setattr(op01_forest, "wanted_of", lambda rows: 600)
    v = np.random.default_rng(6).normal(size=(3000, 32)).astype(np.float32)
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    got = {}
    for r in nearest(frame, F.col("vec_id") % 25 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    w = v.astype(float)
    recall = [len(got[q] & set(np.argsort(np.where(np.arange(3000) == q, np.inf, np.square(w - w[q]).sum(axis=1)))[:10].tolist())) / 10 for q in range(0, 3000, 25)]
    assert np.mean(recall) >= 0.9
