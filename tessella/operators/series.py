"""Ordered series: coverage curves, patience, slides by their balance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed


def coverage(counts: DataFrame, group: str, score: str, levels: list[float]) -> DataFrame:
    """Accuracy of the best-scored part of each group at each level, from rows ``n`` and right ones ``hit`` per score.

    A level keeps whole ties: the shortest run of scores from the top that holds at least its share of the rows.
    """
    whole = Window.partitionBy(group)
    down = whole.orderBy(F.desc(score))
    p = counts.withColumn("upto", F.sum("n").over(down)).withColumn("hits", F.sum("hit").over(down)).withColumn("total", F.sum("n").over(whole))
    at = p.withColumn("level", F.explode(F.array(*map(F.lit, levels)))).where(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.col("level") * F.col("total"))))
    first = at.groupBy(group, "level").agg(F.min(F.struct("upto", "hits")).alias("first"))
    return first.select(group, "level", F.col("first.upto").alias("n_kept"), fixed(F.col("first.hits") / F.col("first.upto"), 6).alias("accuracy"))


def patience(df: DataFrame, group: str, order: str, value: str, steps: int) -> DataFrame:
    """Rows of each series that lie ``steps`` or more after the last new minimum."""
    w = Window.partitionBy(group).orderBy(order)
    best = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_best", best).withColumn("_i", F.row_number().over(w))
    good = F.when(F.col("_best").isNull() | (F.col(value) < F.col("_best")), F.col("_i"))
    return marked.withColumn("_good", F.max(good).over(w)).where(F.col("_i") - F.col("_good") >= steps).drop("_best", "_i", "_good")


def skewed_and_balanced(cells: DataFrame) -> DataFrame:
    """Slides in the lowest tenth of label entropy (``skewed``) and in the upper half (``balanced``) of each cohort."""
    counts = cells.groupBy("cohort", "image_id", "label").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("cohort", "image_id"))
    h = counts.withColumn("p", p).groupBy("cohort", "image_id").agg(fixed(-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12)), 9).alias("h"))
    w = Window.partitionBy("cohort")
    r = h.withColumn("i", F.row_number().over(w.orderBy("h", "image_id")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    low = F.expr("i < greatest(1, n div 10)")
    return r.where(low | F.expr("i >= n div 2")).withColumn("part", F.when(low, "skewed").otherwise("balanced"))
