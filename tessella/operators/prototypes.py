"""Nearest-prototype classification, its temperature, abstention and leave-one-group-out evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import vectors
from tessella.functions.numbers import fixed
from tessella.plans.materialize import broadcast_up_to


def folds(df: DataFrame, parts: int, key: str = "vec_id") -> DataFrame:
    return df.withColumn("fold", F.pmod(F.col(key), F.lit(parts)).cast("int"))


def held_out_centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Centroid of each label for every fold, from the other folds: totals less the fold's own sums, in one pass."""
    long = df.select("fold", label, F.posexplode(vector).alias("i", "x"))
    own = long.groupBy("fold", label, "i").agg(F.sum("x").alias("s"), F.count("x").alias("n"))
    every = own.groupBy(label, "i").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    slots = own.select("fold").distinct().join(every)
    left = slots.join(own, ["fold", label, "i"], "left").withColumn("n", F.col("tn") - F.coalesce("n", F.lit(0))).where("n > 0")
    mean = (F.col("ts") - F.coalesce("s", F.lit(0.0))) / F.col("n")
    one = left.select("fold", F.col(label).alias("prototype"), F.struct("i", mean.alias("c")).alias("e"))
    return one.groupBy("fold", "prototype").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["c"]).alias("centroid"))


def scores(df: DataFrame, centroids: DataFrame, vector: str = "x") -> DataFrame:
    """Cosine of every vector to each prototype of its fold; prototypes are broadcast only while they are few."""
    return df.join(broadcast_up_to(centroids), "fold").withColumn("cosine", vectors.cosine(vector, "centroid")).drop("centroid", vector)


def best(scored: DataFrame, key: str = "vec_id") -> DataFrame:
    """The nearest prototype, the smaller of equals."""
    w = Window.partitionBy(key).orderBy(F.desc(fixed("cosine", 9)), "prototype")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def softmax_by(scored: DataFrame, temperature: float, key: str = "vec_id") -> DataFrame:
    w = Window.partitionBy(key)
    e = F.exp((F.col("cosine") - F.max("cosine").over(w)) / F.lit(temperature))
    return scored.withColumn("e", e).withColumn("prob", F.col("e") / F.sum("e").over(w)).drop("e")


def temperature_grid(scored: DataFrame, label: str, grid: list[float], key: str = "vec_id") -> DataFrame:
    """Mean negative log likelihood of the right prototype at each temperature."""
    per = scored.groupBy(key, label).agg(F.collect_list("cosine").alias("all"), F.max(F.when(F.col("prototype") == F.col(label), F.col("cosine"))).alias("own")).where("own is not null")
    t = per.withColumn("temperature", F.explode(F.array(*map(F.lit, grid))))
    total = F.aggregate(F.transform("all", lambda c: F.exp((c - F.col("own")) / F.col("temperature"))), F.lit(0.0), lambda a, x: a + x)
    return t.groupBy("temperature").agg(F.avg(F.ln(total)).alias("nll"))


def linear_scores(df: DataFrame, weights: np.ndarray, key: str, vector: str) -> DataFrame:
    """Batched inference: one matrix product per Arrow batch, with weights of the model's fixed size sent along."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.vstack(frame[vector].to_numpy()).astype(float) if len(frame) else np.empty((0, len(weights)))
            yield pd.DataFrame({key: frame[key], "score": x @ weights})

    return df.select(key, vector).mapInPandas(run, f"{key} long, score double")
