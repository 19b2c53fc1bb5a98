"""Labelled rows to learn from, shared by the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

FOLDS, HELD_OUT = 4, 2


def fold(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether a row must not be learned from; a row without a doc_id has no label to learn."""
    return F.coalesce(fold(doc_id) == HELD_OUT, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y): at most `most` labelled documents outside the held-out fold, the same
    on every run (smallest hashes of doc_id). Only their ids, so bounded, are broadcast to find the texts.

    Rows of labels that repeat a doc_id count by their mean; null labels don't count.
    """
    known = labels.where(~held_out()).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return cut(texts.join(F.broadcast(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "y")), "doc_id"))
