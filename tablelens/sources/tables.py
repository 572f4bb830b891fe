"""Parquet tables in one folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """``tables("orders")`` reads ``<folder>/orders.parquet``, lazily."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
