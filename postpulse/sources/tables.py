"""Parquet table access for the landed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One landed table. Column pruning and filters reach the scan through Catalyst."""
    if name not in TABLES:
        raise KeyError(name)
    return spark.read.parquet(f"{base.rstrip('/')}/{name}.parquet")
