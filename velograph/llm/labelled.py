"""Bounded samples of labelled documents for fitting the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from velograph.llm.tables import crc_remainder


def first_ids(rows: DataFrame, key: Column, per_key: int, counts: dict | None = None) -> DataFrame:
    """(doc_id, label) of at most ``per_key`` rows of ``rows`` (doc_id) for each key, those whose hashed id is smallest.

    Only ids with a hash under a bound, which lets about twice as many through as are wanted, are ranked, so what meets
    in a task is about ``2 * per_key`` ids a key at any size of the table.  (Should the bound ever let too few through,
    the sample is smaller.)  There are few keys: two classes, or the languages.  ``counts`` may have their numbers of rows.
    """
    own = rows.select("doc_id", key.alias("label"), F.xxhash64("doc_id").alias("_o")).where("label is not null")
    if counts is None:
        counts = {r["label"]: r["n"] for r in own.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bounds = [F.when(F.col("label") == name, F.lit(int(min(1.0, (2 * per_key + 100) / n) * (2**64 - 2**11)) - 2**63)) for name, n in counts.items()]
    under = own.where(F.col("_o") <= F.coalesce(*bounds)) if bounds else own
    order = Window.partitionBy("label").orderBy("_o", "doc_id")
    return under.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= per_key).select("doc_id", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, modulus: int, held: int, per_class: int) -> DataFrame:
    """(doc_id, text, label) of documents with a 0/1 label whose id is not held out, at most ``per_class`` ids a class.

    The sampled ids are at most 2 * ``per_class`` rows, so they are broadcast to the scan of the texts.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).alias("_label"))
    ids = ids.where(F.col("_label").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_remainder(F.col("doc_id"), modulus) != held))
    chosen = first_ids(ids, F.col("_label"), per_class)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
