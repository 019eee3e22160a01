"""The Parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the folder; a column literally named like another in different case is not expected here."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
