from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from velograph.llm.op01_forest import nearest

ROWS = "vec_id long, embedding array<float>, label int, rank int, c1 long"


def brute(rows, asks, k=10):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, v in ok:
        if asks(q):
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w in ok if i != q and len(w) == len(v))
            out[q] = [(i, d) for d, i in near[:k]]
    return out


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def data():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 16))
    rows = [(i, (centres[i % 5] + 0.3 * rng.normal(size=16)).tolist(), 1, 2, 3) for i in range(900)]
    rows += [(1000 + i, rows[7][1], 1, 2, 3) for i in range(40)]  # many copies
    rows += [(2000, None, 1, 2, 3), (2010, [0.0] * 16, 1, 2, 3), (2020, [1.0, None] + [0.0] * 14, 1, 2, 3), (2030, [math.nan] * 16, 1, 2, 3), (2040, [math.inf] + [1.0] * 15, 1, 2, 3), (2050, [], 1, 2, 3), (None, [1.0] * 16, 1, 2, 3), (3000, [1.0, 2.0], 1, 2, 3), (3010, [1.0, 2.5], 1, 2, 3)]
    return rows


def test_small_tables_are_searched_whole(spark):
    rows = data()
    got = answers(nearest(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 10 == 0))
    want = brute(rows, lambda i: i % 10 == 0)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([d for _, d in got[q]], [d for _, d in want[q]], rtol=1e-12, atol=0)


def test_recall_and_parts_of_large_shards(spark):
    rows = data()
    got = answers(nearest(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 10 == 0, wanted=1500, shard_rows=64))
    want = brute(rows, lambda i: i % 10 == 0)
    found = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want]
    assert got.keys() == want.keys() and np.mean(found) >= 0.9


def test_empty_table(spark):
    assert nearest(spark.createDataFrame([], ROWS), F.lit(True)).count() == 0


def test_sparse_queries_ascend_beyond_their_shards(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=16) * 0.1 + 1).tolist(), 1, 2, 3) for i in range(1500)] + [(5000 + i, (rng.normal(size=16) - 9).tolist(), 1, 2, 3) for i in range(10)]
    got = answers(nearest(spark.createDataFrame(rows, ROWS), F.col("vec_id") % 100 == 0, wanted=300))
    want = brute(rows, lambda i: i % 100 == 0)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    assert {i for i, _ in got[5000]} >= {5000 + i for i in range(1, 10)}


def test_rows_of_one_id_are_one_query_and_one_candidate(spark):
    rows = [(i, [float(i), 1.0], 1, 2, 3) for i in range(30)] + [(10, [25.2, 1.0], 1, 2, 3), (3, [11.3, 1.0], 1, 2, 3)]
    got = answers(nearest(spark.createDataFrame(rows, ROWS), F.col("vec_id") == 10, k=4))
    assert list(got) == [10] and [i for i, _ in got[10]] == [25, 26, 9, 11] and len({i for i, _ in got[10]}) == 4
