"""Mid-ranks and exact quantiles from value counts.

Rows are first counted per distinct value, so a hot group is reduced before any shuffle; running totals are then taken
within buckets of the values, with the buckets' own totals as offsets, so no group is sorted in one task.  Buckets are
cut at approximate quantiles of each group's own values, so they hold about as many values whatever these are like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.materialize import broadcast_up_to, cut

#: Buckets of a group; a power of 2.
BUCKETS = 128


def bucketed(counts: DataFrame, group: list[str], value: str, place: Column | None = None) -> DataFrame:
    """``counts`` with ``_b``, a bucket that never falls as ``value`` grows: ``place``, or one by the group's quantiles."""
    if place is not None:
        return counts.withColumn("_b", place)
    levels = [i / BUCKETS for i in range(1, BUCKETS)]
    edges = cut(counts.groupBy(*group).agg(F.percentile_approx(value, levels, 1_000).alias("_edges")), "edges")
    rows = counts.join(broadcast_up_to(edges), group).withColumn("_b", F.lit(0))
    step = BUCKETS // 2
    while step:  # a binary search for the number of edges below the value
        rows = rows.withColumn("_b", F.col("_b") + F.when(F.col(value) > F.get("_edges", F.col("_b") + (step - 1)), step).otherwise(0))
        step //= 2
    return rows.drop("_edges")


def _offsets(rows: DataFrame, group: list[str], n: str) -> DataFrame:
    """Rows of each bucket (``_bn``), of those before it (``_before``) and of its group (``total``)."""
    whole = Window.partitionBy(*group)
    sums = rows.groupBy(*group, "_b").agg(F.sum(n).alias("_bn"))
    return sums.withColumn("_before", F.sum("_bn").over(whole.orderBy("_b")) - F.col("_bn")).withColumn("total", F.sum("_bn").over(whole))


def cumulative(counts: DataFrame, group: list[str], value: str = "v", n: str = "n", place: Column | None = None) -> DataFrame:
    """``counts`` with ``below`` (rows of smaller values), ``tie`` (rows of the same value) and ``total`` of the group.

    A group may have several rows of one value, as in counts that are finer than the group.
    """
    rows = bucketed(counts, group, value, place)
    upto = F.sum(n).over(Window.partitionBy(*group, "_b").orderBy(value))
    tie = F.sum(n).over(Window.partitionBy(*group, "_b", value))
    inside = rows.withColumn("_upto", upto).withColumn("tie", tie)
    return inside.join(_offsets(rows, group, n).drop("_bn").hint("merge"), [*group, "_b"]).withColumn("below", F.col("_before") + F.col("_upto") - F.col("tie")).drop("_b", "_upto", "_before")


def mid_rank(counts: DataFrame, group: list[str], value: str = "v", n: str = "n") -> DataFrame:
    """``counts`` with ``u``: the mean rank of the value's ties over the group's rows, in (0, 1]."""
    u = (F.col("below") + (F.col("tie") + 1) / 2) / F.col("total")
    return cumulative(counts, group, value, n).withColumn("u", u).drop("below", "tie", "total")


def quantiles(counts: DataFrame, group: list[str], levels: list[float], value: str = "v", n: str = "n", name: str = "q", place: Column | None = None) -> DataFrame:
    """Exact quantiles (linear between neighbouring ranks) of each group as an array, with the group's rows ``rows``.

    Only the buckets that hold a rank asked for are looked into.
    """
    rows = bucketed(counts.select(*group, value, n), group, value, place)

    def ranks_of(total: Column) -> list[Column]:
        at = [F.lit(float(level)) * (total - 1) for level in levels]
        return [x.cast("long") for a in at for x in (F.floor(a), F.ceil(a))]

    asked = F.filter(F.array_distinct(F.array(*ranks_of(F.col("total")))), lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_bn")))
    needed = _offsets(rows, group, n).withColumn("_ranks", asked).where(F.size("_ranks") > 0).drop("_bn")
    inside = rows.join(needed, [*group, "_b"]).groupBy(*group, "_b", value, "_before", "total", "_ranks").agg(F.sum(n).alias("_n"))
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*group, "_b").orderBy(value))
    hits = inside.withColumn("_upto", upto).withColumn("_rank", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto")))))
    found = hits.groupBy(*group).agg(F.max("total").alias("rows"), F.map_from_entries(F.collect_list(F.struct("_rank", value))).alias("_at"))
    wanted = ranks_of(F.col("rows"))
    results = []
    for i, level in enumerate(levels):
        lo, hi = (F.element_at("_at", r) for r in wanted[2 * i : 2 * i + 2])
        place_of = F.lit(float(level)) * (F.col("rows") - 1)
        results.append(lo + (hi - lo) * (place_of - F.floor(place_of)))
    return found.select(*group, "rows", F.array(*results).alias(name))
