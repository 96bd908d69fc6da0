"""Arrays of doubles as vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: str | Column, b: str | Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors; NULL if one has no length."""
    length = norm(a) * norm(b)
    return dot(a, b) / F.when(length > 0, length)


def distance(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def softmax_top(logits: Column, temperature: float) -> Column:
    """Greatest softmax probability, with the maximum taken off before exponentials."""
    top = F.array_max(logits)
    return 1 / _sum(F.transform(logits, lambda z: F.exp((z - top) / F.lit(temperature))))


def bounded_correction(value: Column, by: Column, weight: float, offset: float, bound: float) -> Column:
    return value + F.lit(bound) * F.tanh(F.lit(weight) * by + F.lit(offset))


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label, summed by position so that partial sums are combined before the shuffle."""
    long = df.select(label, F.posexplode(vector).alias("i", "x"))
    means = long.groupBy(label, "i").agg(F.avg("x").alias("c"))
    return means.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("centroid"))
