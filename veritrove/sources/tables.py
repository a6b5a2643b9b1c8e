"""Readers of the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``; columns and filters are pushed to the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
