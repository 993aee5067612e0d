"""Bounded samples of labelled rows, and labels joined to per-document facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioquery.llm.common import held_out


def label_rows(labels: DataFrame, column: str) -> DataFrame:
    """One learnable label per document: nulls and held-out ids go, the smallest of repeated labels counts."""
    rows = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))


def fit_sample(docs: DataFrame, labels: DataFrame, column: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most ``rows`` labelled rows, chosen by a hash of the id.

    The chosen ids are at most ``rows``, so they are broadcast and no text is shuffled. If a doc_id repeats in
    ``docs``, each of its rows carries the label.
    """
    chosen = label_rows(labels, column).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
