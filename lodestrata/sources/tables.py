"""Parquet tables of a directory, one ``<name>.parquet`` each (a file or a folder of files)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The table ``name`` under ``root``; columns are pruned and filters pushed by the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")
