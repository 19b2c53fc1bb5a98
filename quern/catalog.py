"""The engine's queries with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.plans import app, text, vectors, wrapped

MODULES = (vectors, text, wrapped, app)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened search with a gap cutoff."""
    return vectors.QUERIES["search_whitened_gap_a"](spark, sf_dir)


def queries() -> dict:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for m in MODULES for name, q in m.ORACLES.items()}
