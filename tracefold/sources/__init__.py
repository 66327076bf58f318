"""Readers: the store's tables and capture files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, store: str, name: str) -> DataFrame:
    """A table of the store directory."""
    return spark.read.parquet(f"{store}/{name}.parquet")
