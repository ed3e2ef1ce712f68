"""Bounded, reproducible samples of labelled documents for fitting a classifier.

Only ids and labels are ranked; the texts of the chosen ids are then read by a pushed-down filter, so no text is sorted or shuffled.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Row, Window as W, functions as F


def chosen_ids(rows: DataFrame, per_label: int, most: int, seed: str) -> list[Row]:
    """(doc_id, label) of at most ``per_label`` documents of each label and ``most`` in all, in the order of a seeded hash of the id.

    ``rows`` has doc_id and label (a string); a document with several labels counts under the smallest.
    """
    one = rows.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("label").alias("label"))
    one = one.withColumn("k", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    # the first of each of 256 slots of the order, and then of those: no task gets a label whole
    slot = W.partitionBy("label", F.substring("k", 1, 2)).orderBy("k")
    first = one.withColumn("turn", F.row_number().over(slot)).filter(F.col("turn") <= per_label)
    turn = F.row_number().over(W.partitionBy("label").orderBy("k"))
    return first.withColumn("turn", turn).filter(F.col("turn") <= per_label).orderBy("turn", "label").limit(most).select("doc_id", "label").collect()


def labelled_sample(rows: DataFrame, docs: DataFrame, per_label: int, most: int, seed: str) -> list[tuple[str, str]]:
    """(text, label) of the ``chosen_ids`` of ``rows``, in their order; ``docs`` has doc_id and text."""
    chosen = chosen_ids(rows, per_label, most, seed)
    if not chosen:
        return []
    texts = docs.filter(F.col("doc_id").isin([r.doc_id for r in chosen])).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    by_id: dict = {}
    for r in texts.collect():
        by_id[r.doc_id] = min(r.text, by_id.get(r.doc_id, r.text))
    return [(by_id[r.doc_id], r.label) for r in chosen if r.doc_id in by_id]
