"""A training-corpus pipeline: toxic documents go, near-duplicates go, repeated passages go, documents with benchmark
passages go, and what is left is mixed from its sources by weight.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velograph.llm import near_copies, op03_mixing, op06_toxicity, op07_suffix, op08_decontaminate
from velograph.llm.tables import table
from velograph.plans.materialize import materialize

#: A document is rejected as toxic from this score on, as the operator predicts.
TOXIC = op06_toxicity.THRESHOLD


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, fitted on the labelled ones among ``docs``, does not reject.

    The whole text decides, however long; a null one counts as empty.  Repeated rows stay or go together.  Without labels
    to learn from (none, one class only, or too few of a class) no document is rejected.
    """
    return op06_toxicity.drop_toxic(docs, op06_toxicity.train(docs, table(spark, sf_dir, "labels")), TOXIC)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (Jaccard 0.8 on five words), the one with the smallest doc_id.

    Null, empty and blank texts are duplicates of each other.  Null ids come last; rows of equal or null ids are told apart
    by their texts, and of rows equal in both one stays.
    """
    return near_copies.drop_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the bytes of any 200-byte string that is found elsewhere too.

    Null texts stay null and a text may become empty; every row stays, repeated ones too, which repeat each other.
    """
    return op07_suffix.without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item; those with a null or empty text share none.

    The text alone decides, so repeated or null ids take no other row along.
    """
    return op08_decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of the documents that the mix takes at least once.

    A text that is null or has no words has size 0; it may be taken and adds nothing.  Repeated rows are documents of
    their own, and a null source is a source.
    """
    return op03_mixing.mixture(docs).where(F.col("copies") > 0).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("decontamination", decontamination),
    ("mixing", mixing),
]
#: SQL has neither the fitted model nor XXH64; the tests hold run() against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; an empty table gives an empty result, and further columns stay until mixing."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
