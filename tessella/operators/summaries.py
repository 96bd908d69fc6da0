"""Summaries of groups from counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed


def tie_mass(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Share of each group's most common value and the number of values; NULL is a value."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*group).agg(fixed(F.max("n") / F.sum("n"), 6).alias("tie_mass"), F.count(F.lit(1)).alias("n_values"))


def entropy(df: DataFrame, group: list[str], category: str) -> DataFrame:
    """Shannon entropy (natural log) of each group's categories, and the largest, ties to the first by name."""
    counts = df.groupBy(*group, category).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*group)
    p = counts.withColumn("p", F.col("n") / F.sum("n").over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("n"), category)))
    return p.groupBy(*group).agg(fixed(-F.sum(F.col("p") * F.ln(F.col("p") + 1e-12)), 6).alias("entropy"), F.max(F.when(F.col("rn") == 1, F.col(category))).alias("dominant"))


def t_bar(degrees: Column) -> Column:
    """What Student's t exceeds in 5 of 100 cases on either side, by its expansion around the normal quantile; from four
    degrees of freedom on it is off by less than a thousandth."""
    # fixed values: the normal quantile, and the expansion's coefficients at it
    parts = (1.959964, 2.372271, 2.822499, 2.555850, 1.589536)
    out, power = F.lit(0.0), F.lit(1.0)
    for part in parts:
        out, power = out + part / power, power * degrees
    return out


def t_interval(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Number, mean, standard error and interval of a mean (95 %) of each group; NULL for a single value."""
    n = F.count(value)
    b = df.groupBy(*group).agg(n.alias("n"), F.avg(value).alias("mean"), (F.stddev_samp(value) / F.sqrt(n)).alias("sem"))
    b = b.withColumn("t_bar", F.when(F.col("n") > 1, t_bar(F.col("n") - 1.0)))
    return b.withColumns({"low": F.col("mean") - F.col("sem") * F.col("t_bar"), "high": F.col("mean") + F.col("sem") * F.col("t_bar")})
