"""The cleaning pipeline over documents: toxic documents go, then repeated lines, near-duplicate documents and repeated
passages, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm import best_fit_packing, line_dedup, simhash_near_dedup, substring_dedup, toxicity
from quern.llm.common import cut, scratch, table

#: Near-duplicate documents share word shingles of this length.
SHINGLE = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_near_dedup.dedup(docs, SHINGLE)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("substring dedup", dedup_passages),
    ("best-fit packing", pack),
]

#: The learned grammar and the tokenizer can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another from documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with scratch():  # what a stage wrote for itself goes when its result is written
            docs = cut(stage(spark, docs, sf_dir), keep=True)
    return docs
