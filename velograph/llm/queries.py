"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from velograph.llm.op01_forest import op1_prefix_forest
from velograph.llm.op02_tokens import op2_token_counts
from velograph.llm.op03_mixing import OP3_SQL, op3_source_mix
from velograph.llm.op04_quality import op4_quality
from velograph.llm.op05_simhash import op5_simhash_dedup
from velograph.llm.op06_toxicity import op6_toxicity
from velograph.llm.op07_suffix import op7_suffix_dedup
from velograph.llm.op08_decontaminate import OP8_SQL, op8_decontamination
from velograph.llm.op09_extend import op9_passage_dedup
from velograph.llm.op10_language import op10_language_id
from velograph.llm.op11_divergence import OP11_SQL, op11_source_divergence
from velograph.llm.op12_balltree import OP12_SQL, op12_centroid_clusters
from velograph.llm.op13_quantisation import OP13_SQL, op13_embedding_dedup

_ALL = (
    op1_prefix_forest, op2_token_counts, op3_source_mix, op4_quality, op5_simhash_dedup, op6_toxicity, op7_suffix_dedup,
    op8_decontamination, op9_passage_dedup, op10_language_id, op11_source_divergence, op12_centroid_clusters, op13_embedding_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        op3_source_mix.__name__: OP3_SQL,
        op8_decontamination.__name__: OP8_SQL,
        op11_source_divergence.__name__: OP11_SQL,
        op12_centroid_clusters.__name__: OP12_SQL,
        op13_embedding_dedup.__name__: OP13_SQL,
    }
