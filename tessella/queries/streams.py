"""Streaming extension (2.15): micro-batches over the events table, held against batch SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed
from tessella.streaming import windows

from .registry import Registry

REGISTRY = register = Registry()


@register("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events per day and type."""
    t = windows.tumbling(spark, d)
    return t.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", fixed("total", 4).alias("total"))


@register("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Events once each, counted by type."""
    return windows.deduplicated(spark, d).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM c GROUP BY 1""")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user."""
    return windows.sessions(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.max("n").alias("longest"))
