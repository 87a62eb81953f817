from __future__ import annotations

import corpus_pipeline

from velograph.llm import op06_toxicity
from velograph.llm.op08_decontaminate import drop_contaminated


def test_toxic_from_the_threshold_of_the_operator():
    assert corpus_pipeline.TOXIC == op06_toxicity.THRESHOLD


def test_clean_rows_with_the_id_of_a_contaminated_one_stay(spark):
    item = " ".join(f"w{i}" for i in range(20))
    rows = [(None, f"a {item} b"), (None, "clean one"), (None, None), (5, item), (5, "clean two"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = drop_contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [rows[1], rows[2], rows[4], rows[5]]))
