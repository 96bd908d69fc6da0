"""Reading the tables of a directory, one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` below ``folder``; columns are pruned by whatever the query selects."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
