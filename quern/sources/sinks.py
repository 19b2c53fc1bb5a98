"""Sinks: records, vectors, weights, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def embedding_columns(df: DataFrame, dim: int, name: str = "file", vector: str = "vector") -> DataFrame:
    """(file, d_0, d_1, ...)."""
    return df.select(F.col(name).alias("file"), *[F.col(vector)[i].alias(f"d_{i}") for i in range(dim)])


def write_embeddings(df: DataFrame, path: str, dim: int) -> None:
    embedding_columns(df, dim).write.mode("overwrite").option("header", True).csv(path)


def write_weights(df: DataFrame, path: str) -> None:
    """The same table in three formats."""
    df.write.mode("overwrite").parquet(f"{path}/parquet")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    df.write.mode("overwrite").json(f"{path}/json")


def fused_meta(df: DataFrame, weights: list[str]) -> DataFrame:
    """The columns that describe fused vectors, weights to eight decimals."""
    return df.select("field", "doc_id", *[T.fixed(w, 8).alias(w) for w in weights])


def write_fused(df: DataFrame, path: str, weights: list[str]) -> None:
    df.write.mode("overwrite").partitionBy("field").parquet(f"{path}/vectors")
    fused_meta(df, weights).write.mode("overwrite").option("header", True).csv(f"{path}/meta")


def write_calibration(mean: DataFrame, path: str) -> None:
    mean.write.mode("overwrite").parquet(path)


def report(hits: DataFrame) -> DataFrame:
    """One ranked text of hits (rank, doc_id, label, score, text): few rows, as they come behind a limit."""
    line = F.concat(F.format_string("%2d", F.col("rank").cast("int")), F.lit(". "), F.col("doc_id").cast("string"), F.lit(" ["), F.col("label").cast("string"), F.lit("] "), T.percent("score"), F.lit("%"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"])
    return hits.agg(F.array_join(lines, "\n").alias("report"))
