"""File sources and sinks that keep what the tables say: CSV, JSON lines, partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.plans.materialize import cut, shared_path, until_exit


def csv_round_trip(df: DataFrame) -> DataFrame:
    """Write text columns as CSV and read them with their own schema; empty strings come back empty, 'NA' stays a name."""
    path = shared_path(df.sparkSession, "csv")
    df.write.option("header", True).option("quoteAll", True).option("escape", '"').option("nullValue", "\x00").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return (
        df.sparkSession.read.schema(df.schema).option("header", True).option("escape", '"').option("multiLine", True)
        .option("nullValue", "\x00").option("emptyValue", "").csv(until_exit(df.sparkSession, path))
    )


def json_round_trip(df: DataFrame) -> DataFrame:
    """Write rows as JSON lines and read them with their own schema, so nothing is inferred."""
    path = shared_path(df.sparkSession, "json")
    df.write.json(path)
    return df.sparkSession.read.schema(df.schema).json(until_exit(df.sparkSession, path))


def partitioned(df: DataFrame, *keys: str) -> DataFrame:
    """Write Parquet partitioned by ``keys`` and read it back; filters on the keys skip folders."""
    path = shared_path(df.sparkSession, "parts")
    df.write.partitionBy(*keys).parquet(path)
    return df.sparkSession.read.parquet(until_exit(df.sparkSession, path))


def list_round_trip(df: DataFrame, name: str) -> DataFrame:
    """Write a frame's one column as a CSV list without a header, and read it as ``name`` by a declared schema."""
    path = shared_path(df.sparkSession, "list")
    options = {"header": False, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.options(quoteAll=True, **options).csv(path)
    return df.sparkSession.read.schema(f"`{name}` string").options(**options).csv(until_exit(df.sparkSession, path))


def stored_manifest(entries: DataFrame) -> DataFrame:
    """A manifest (a key, ``digest`` and ``n_bytes``) as it is stored."""
    return cut(entries, "manifest")


def verify(stored: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """``key`` and ``state`` of everything that a stored manifest lists or that is there: same, size, digest, missing or new."""
    now = present.select(key, F.col("digest").alias("_digest"), F.col("n_bytes").alias("_bytes"))
    state = (
        F.when(F.col("digest").isNull(), "new").when(F.col("_digest").isNull(), "missing")
        .when(F.col("n_bytes") != F.col("_bytes"), "size").when(F.col("digest") != F.col("_digest"), "digest").otherwise("same")
    )
    return stored.join(now, key, "full").select(key, state.alias("state"))
