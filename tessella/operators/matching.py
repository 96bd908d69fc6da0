"""Profiles of labels by marker, their distances by an equi-join on the marker, and the nearest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed


def standard_profiles(counts: DataFrame, group: list[str], label: str, least: int) -> DataFrame:
    """Mean per (group, label, marker) with at least ``least`` rows, standardised over the labels; NULL if all agree."""
    means = counts.groupBy(*group, label, "marker").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("n")).where(F.col("n") >= least)
    w = Window.partitionBy(*group, "marker")
    spread = F.stddev_pop("mean").over(w)
    return means.withColumn("z", (F.col("mean") - F.avg("mean").over(w)) / F.when(spread != 0, spread)).select(*group, label, "marker", "z").where("z is not null")


def squares(profiles: DataFrame, least_shared: int) -> DataFrame:
    """Root mean square difference of every two labels of different cohorts; profiles are labels, not rows, so few."""
    a = profiles.select("marker", F.col("cohort").alias("cohort_a"), F.col("label").alias("label_a"), F.col("z").alias("za"))
    b = profiles.select("marker", F.col("cohort").alias("cohort_b"), F.col("label").alias("label_b"), F.col("z").alias("zb"))
    gap = F.col("za") - F.col("zb")
    return (
        a.join(b, "marker").where("cohort_a <> cohort_b").groupBy("cohort_a", "label_a", "cohort_b", "label_b")
        .agg(F.count(F.lit(1)).alias("n_shared"), F.sqrt(F.avg(gap * gap)).alias("distance")).where(F.col("n_shared") >= least_shared)
    )


def profile_distances(profiles: DataFrame, least_shared: int) -> DataFrame:
    """Each unordered pair of labels of different cohorts with its number of shared markers and distance."""
    return squares(profiles, least_shared).where("cohort_a < cohort_b").withColumn("distance", fixed("distance", 6))


def nearest(profiles: DataFrame, least_shared: int, most: float) -> DataFrame:
    """The nearest label of each other cohort; ties go to the alphabetically first, and beyond ``most`` it is NOVEL."""
    order = Window.partitionBy("cohort_a", "label_a", "cohort_b").orderBy(fixed("distance", 9), "label_b")
    first = squares(profiles, least_shared).withColumn("rn", F.row_number().over(order)).where("rn = 1")
    return first.select(
        F.col("cohort_a").alias("cohort"), F.col("label_a").alias("label"), F.col("cohort_b").alias("other"),
        F.when(F.col("distance") <= most, F.col("label_b")).otherwise("NOVEL").alias("nearest"), fixed("distance", 6).alias("distance"),
    )
