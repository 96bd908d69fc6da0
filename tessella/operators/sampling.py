"""Samples and splits in the order of a seeded hash, so that they are the same in every run and engine.

A per-group draw first keeps the best of each hash shard and then the best of those, so a hot group is never sorted in
one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 32


def seeded(seed: int) -> Column:
    """Hash of a cell's id, load and place."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("cell_id").cast("string"), F.col("load_id").cast("string"), F.bround(F.coalesce("x_px", F.lit(0.0)), 0).cast("long").cast("string")))


def first_of(df: DataFrame, group: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each group in ``order``, by shards first; ``rn`` counts from 1."""
    sharded = df.withColumn("_shard", F.pmod(F.xxhash64(*order), F.lit(SHARDS)))
    inner = F.row_number().over(Window.partitionBy(*group, "_shard").orderBy(*order))
    some = sharded.withColumn("rn", inner).where(F.col("rn") <= n).drop("rn", "_shard")
    return some.withColumn("rn", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rn") <= n)


def round_robin(cells: DataFrame, group: str, strata: list[str], n: int, seed: int = 7) -> DataFrame:
    """``n`` rows of each group, every stratum giving one per turn; a stratum can give at most ``n``."""
    hashed = cells.withColumn("h", seeded(seed)).select(group, *strata, "cell_id", "h")
    turns = first_of(hashed, [group, *strata], ["h", "cell_id"], n).withColumnRenamed("rn", "turn")
    return first_of(turns, [group], ["turn", "h", "cell_id"], n)


def capped(cells: DataFrame, group: list[str], n: int, seed: int = 7) -> DataFrame:
    return first_of(cells.withColumn("h", seeded(seed)).select(*group, "cell_id", "h"), group, ["h", "cell_id"], n)


def balanced(cells: DataFrame, group: str, n: int, seed: int = 7) -> DataFrame:
    """``n`` draws of each group, with replacement where it has fewer rows."""
    some = first_of(cells.withColumn("h", seeded(seed)).select(group, "cell_id", "h"), [group], ["h", "cell_id"], n)
    sized = some.withColumn("have", F.count(F.lit(1)).over(Window.partitionBy(group)))
    draws = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: j % F.col("have") == F.col("rn") - 1)
    return sized.select(group, F.explode(draws).alias("draw"), "cell_id").withColumn("draw", F.col("draw").cast("long"))


def group_split(cells: DataFrame, group: str, unit: str, test: float = 0.2, val: float = 0.12, seed: int = 7) -> DataFrame:
    """``unit`` of each ``group`` as test, val or train, at least one test and one val, rounding half to even."""
    units = cells.select(group, unit).distinct().withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), unit)))
    w = Window.partitionBy(group)
    ranked = units.withColumn("rn", F.row_number().over(w.orderBy("h", unit))).withColumn("k", F.count(F.lit(1)).over(w))
    n_test = F.greatest(F.lit(1.0), F.bround(F.lit(test) * F.col("k"), 0))
    n_val = F.greatest(F.lit(1.0), F.bround(F.lit(val) * F.col("k"), 0))
    return ranked.select(group, unit, F.when(F.col("rn") <= n_test, "test").when(F.col("rn") <= n_test + n_val, "val").otherwise("train").alias("split"))


def masked(df: DataFrame, key: str, names: str, share: float, seed: int = 7) -> DataFrame:
    """For each row the hidden ``marker`` names: the first by hash, ``share`` of them and at least one."""
    hashed = F.transform(names, lambda m: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"), m)).alias("h"), m.alias("m")))
    k = F.greatest(F.lit(1.0), F.bround(F.lit(share) * F.size(names), 0)).cast("int")
    return df.select(key, F.explode(F.slice(F.array_sort(hashed), F.lit(1), k)).alias("x")).select(key, F.col("x.m").alias("marker"))
