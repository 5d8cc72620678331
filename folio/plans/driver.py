"""The engine's own queries and their SQL, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.plans import details, documents, kernels


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text search in real files: write, read, lay out, find."""
    return documents.rt_search_literal(spark, sf_dir)


def queries() -> dict:
    return documents.QUERIES | kernels.QUERIES | details.QUERIES


def oracle_sql() -> dict:
    return documents.ORACLES | kernels.ORACLES | details.ORACLES
