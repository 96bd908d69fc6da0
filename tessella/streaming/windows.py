"""Windowed counts over a stream of events, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.plans.materialize import shared_path, until_exit


def _events(spark: SparkSession, folder: str, name: str = "events") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_parent(folder, name))
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def _parent(folder: str, name: str) -> str:
    """A glob that names one table, be it a file or a folder."""
    return f"{folder}/{name}.parquet*"


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Write the stream to Parquet until all present input is taken, then read the result."""
    spark = stream.sparkSession
    base = shared_path(spark, "stream")
    if mode == "append":
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        until_exit(spark, base)
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    # complete results are replaced by each micro-batch; the last one stands
    latest = []

    def keep(batch: DataFrame, number: int) -> None:
        path = f"{base}/out-{number}"
        batch.write.mode("overwrite").parquet(path)
        latest.append(path)

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    until_exit(spark, base)
    return spark.read.schema(stream.schema).parquet(latest[-1]) if latest else spark.createDataFrame([], stream.schema)


def tumbling(spark: SparkSession, folder: str, width: str = "1 day") -> DataFrame:
    """Events per window and type; the result is complete, whatever the order of arrival."""
    counts = _events(spark, folder).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return run_to_end(counts.select(F.col("w.start").alias("start"), "event_type", "n", "total"), "complete")


def deduplicated(spark: SparkSession, folder: str, delay: str = "1 hour") -> DataFrame:
    """Each event once; state older than the watermark is dropped."""
    return run_to_end(_events(spark, folder).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]))


def sessions(spark: SparkSession, folder: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user, ended by a pause of ``gap``."""
    s = _events(spark, folder).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return run_to_end(s.select("user_id", F.col("w.start").alias("start"), "n"), "complete")
