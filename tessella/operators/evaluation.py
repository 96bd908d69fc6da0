"""Scores of predictions and partitions, from counts of (truth, prediction) or (class, class) pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed

from . import ranks


def pairwise_ks(counts: DataFrame, group: str, marker: str) -> DataFrame:
    """Greatest difference of the distribution functions of every two groups, per marker.

    A value's running total is taken within buckets of the marker's values; a value that one group lacks keeps the total of
    the last one that it has, so both are carried as signed steps over the union of their values.
    """
    counts = ranks.bucketed(counts.select(group, marker, "v", "n"), [marker], "v").withColumnRenamed("_b", "k")
    totals = counts.groupBy(group, marker).agg(F.sum("n").alias("t"))
    a = totals.select(marker, F.col(group).alias("a"), F.col("t").alias("ta"))
    b = totals.select(marker, F.col(group).alias("b"), F.col("t").alias("tb"))
    pairs = a.join(b, marker).where("a < b")
    ours = pairs.join(counts.withColumnRenamed(group, "a"), [marker, "a"]).select(marker, "a", "b", "k", "v", (F.col("n") / F.col("ta")).alias("step"))
    theirs = pairs.join(counts.withColumnRenamed(group, "b"), [marker, "b"]).select(marker, "a", "b", "k", "v", (-F.col("n") / F.col("tb")).alias("step"))
    steps = ours.unionByName(theirs).groupBy(marker, "a", "b", "k", "v").agg(F.sum("step").alias("step"))
    sums = steps.groupBy(marker, "a", "b", "k").agg(F.sum("step").alias("s"))
    before = sums.select(marker, "a", "b", "k", (F.sum("s").over(Window.partitionBy(marker, "a", "b").orderBy("k")) - F.col("s")).alias("before"))
    inner = F.sum("step").over(Window.partitionBy(marker, "a", "b", "k").orderBy("v"))
    return steps.withColumn("inner", inner).join(before, [marker, "a", "b", "k"]).groupBy(marker, "a", "b").agg(F.max(F.abs(F.col("before") + F.col("inner"))).alias("ks"))


def auroc_of_labels(counts: DataFrame, group: list[str], label: str, least: int, bar: float) -> DataFrame:
    """Each label against the rest of its group: (rank sum - n1 (n1 + 1) / 2) / (n1 n0), with ties at mid-rank."""
    totals = counts.groupBy(*group).agg(F.sum("n").alias("t"))
    u = ranks.mid_rank(counts, group)
    g = u.groupBy(*group, label).agg(F.sum("n").alias("n1"), F.sum(F.col("u") * F.col("n")).alias("su")).join(totals, group)
    n1, n0 = F.col("n1"), F.col("t") - F.col("n1")
    area = (F.col("su") * F.col("t") - n1 * (n1 + 1) / 2.0) / (n1 * n0)
    return g.where((n1 >= least) & (n0 >= least)).select(*group, label, fixed(area, 6).alias("auroc"), (area >= bar).alias("pass"))


def class_scores(pairs: DataFrame, group: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of every class in the truth; a class only predicted costs precision elsewhere."""
    sides = F.when(F.col("truth") == F.col("pred"), F.array("truth")).otherwise(F.array("truth", "pred"))
    long = pairs.select(*group, "truth", "pred", "n", F.explode(sides).alias("class"))

    def total(condition):
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    is_t, is_p = F.col("truth") == F.col("class"), F.col("pred") == F.col("class")
    s = long.groupBy(*group, "class").agg(total(is_t & is_p).alias("hit"), total(is_t).alias("support"), total(is_p).alias("p")).where("support > 0")
    return s.select(*group, "class", "support", (F.col("hit") / F.when(F.col("p") > 0, F.col("p"))).alias("prec"), (F.col("hit") / F.col("support")).alias("rec"), (2.0 * F.col("hit") / (F.col("support") + F.col("p"))).alias("f1"))


def chance_levels(counts: DataFrame, group: str, n: str) -> DataFrame:
    total = F.sum(n).over(Window.partitionBy(group)).cast("double")
    p = counts.withColumn("p", F.col(n) / total)
    return p.groupBy(group).agg(fixed(F.max("p"), 6).alias("majority"), fixed(F.sum(F.col("p") * F.col("p")), 6).alias("chance"), fixed(-F.sum(F.col("p") * F.log2("p")), 6).alias("bits"))


def explained_by(counts: DataFrame, group: list[str], label: str) -> DataFrame:
    v, n = F.col("v"), F.col("n")
    c = counts.groupBy(*group, label).agg(F.sum(n).alias("n"), F.sum(v * n).alias("s"), F.sum(v * v * n).alias("ss"))
    g = c.groupBy(*group).agg((F.sum("ss") - F.sum(F.col("s") * F.col("s") / F.col("n"))).alias("sse"), (F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")).alias("sst"))
    return g.select(*group, fixed(F.when(F.col("sst") > 1e-12, 1 - F.col("sse") / F.col("sst")), 5).alias("r2"))


def _choose2(x):
    return x * (x - 1) / 2.0


def adjusted_rand(parts: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Adjusted Rand index with continuous weights; 0 where it isn't defined."""
    t = parts.groupBy(a, b).agg(F.sum(F.col(weight).cast("double")).alias("n"))

    def pairs(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sum(_choose2(F.col("n"))).alias(name))

    rows = t.groupBy(a).agg(F.sum("n").alias("n"))
    columns = t.groupBy(b).agg(F.sum("n").alias("n"))
    x = pairs(t, "ij").join(pairs(rows, "i")).join(pairs(columns, "j")).join(t.agg(_choose2(F.sum("n")).alias("c")))
    expected = F.col("i") * F.col("j") / F.when(F.col("c") != 0, F.col("c"))
    room = (F.col("i") + F.col("j")) / 2 - expected
    return x.select(fixed(F.coalesce((F.col("ij") - expected) / F.when(room != 0, room), F.lit(0.0)), 6).alias("ari"))


def information(parts: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two partitions against the mean of their entropies and against each."""
    t = parts.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))

    def h(df: DataFrame, name: str) -> DataFrame:
        return df.agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias(name))

    x = h(t, "hab").join(h(t.groupBy(a).agg(F.sum("n").alias("n")), "ha")).join(h(t.groupBy(b).agg(F.sum("n").alias("n")), "hb"))
    shared = F.col("ha") + F.col("hb") - F.col("hab")

    def share(of):
        return fixed(shared / F.when(of != 0, of), 6)

    both = (F.col("ha") + F.col("hb")) / 2
    return x.select(share(both).alias("nmi"), share(F.col("ha")).alias("homogeneity"), share(F.col("hb")).alias("completeness"), share(both).alias("v"))


def pair_counts(parts: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of rows, and how often both partitions agree whether the two belong together."""
    t = parts.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))

    def pairs(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.sum(_choose2(F.col("n"))).alias(name))

    x = pairs(t, "both").join(pairs(t.groupBy(a).agg(F.sum("n").alias("n")), "i")).join(pairs(t.groupBy(b).agg(F.sum("n").alias("n")), "j")).join(t.agg(_choose2(F.sum("n")).alias("c")))
    agree = F.col("c") - F.col("i") - F.col("j") + 2 * F.col("both")
    return x.select(F.col("c").cast("long").alias("n_pairs"), fixed(agree / F.col("c"), 6).alias("agreement"), F.col("both").cast("long").alias("both"))


def bootstrap(df: DataFrame, group: str, order: str, value: str, times: int) -> DataFrame:
    """Percentile interval of the mean over resamples; draw s, i is the row at the hash of (s, i) modulo the size."""
    w = Window.partitionBy(group)
    rows = df.withColumn("i", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    s = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
    drawn = rows.select(group, "i", "n", s.alias("s"))
    at = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("s").cast("string"), F.col("i").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("n")
    means = drawn.withColumn("at", at).join(rows.select(group, F.col("i").alias("at"), F.col(value).alias("x")), [group, "at"]).groupBy(group, "s").agg(F.avg("x").alias("m"))
    return means.groupBy(group).agg(fixed(F.percentile("m", F.lit(0.025)), 6).alias("low"), fixed(F.percentile("m", F.lit(0.975)), 6).alias("high"))


def permutation(parts: DataFrame, order: list[str], a: str, b: str, times: int) -> DataFrame:
    """Ordered pairs that share both classes, against shuffles of the first class by hash; rows are labels, so few."""
    rows = parts.select(a, b, F.row_number().over(Window.orderBy(*order)).alias("i"))
    s = rows.select(a, "i", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("s"))
    key = F.md5(F.concat_ws("|", F.col("s").cast("string"), F.col("i").cast("string")))
    moved = s.withColumn("j", F.row_number().over(Window.partitionBy("s").orderBy(key, "i"))).select("s", a, F.col("j").alias("i"))

    def same(df: DataFrame, *keys: str) -> DataFrame:
        n = df.groupBy(*keys, a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
        return n.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("same"))

    null = same(moved.join(rows.select("i", b), "i"), "s")
    observed = same(rows).withColumnRenamed("same", "observed")
    p = (1 + F.count_if(F.col("same") >= F.col("observed"))) / F.lit(times + 1)
    return null.join(observed).groupBy("observed").agg(fixed(p, 6).alias("p_value"), F.percentile("same", F.lit(0.999)).alias("top"))


def many_to_one(pairs: DataFrame, group: list[str]) -> DataFrame:
    n = pairs.groupBy(*group, "pred", "truth").agg(F.sum("n").alias("n"))
    top = n.groupBy(*group, "pred").agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    return top.groupBy(*group).agg(fixed(F.sum("top") / F.sum("total"), 6).alias("agreement"))


def rank_aligned_gaps(scores: DataFrame) -> DataFrame:
    r = scores.select("cohort", "f1", F.row_number().over(Window.partitionBy("cohort").orderBy(F.desc("f1"), "class")).alias("rank"))
    b = r.select("rank", F.col("cohort").alias("cohort_b"), F.col("f1").alias("f1_b"))
    return r.join(b, "rank").where("cohort < cohort_b").groupBy(F.col("cohort").alias("cohort_a"), "cohort_b").agg(F.count(F.lit(1)).alias("n"), fixed(F.avg(F.col("f1") - F.col("f1_b")), 6).alias("mean_gap"))


def _assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one assignment with the greatest gain, by shortest augmenting paths with potentials."""
    n, m = gain.shape
    if n > m:
        return [(i, j) for j, i in _assign(gain.T)]
    cost = gain.max() - gain
    row, column, match = np.zeros(n), np.zeros(m), np.full(m, -1)
    for start in range(n):
        slack, via, done = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        i, j, shift = start, -1, 0.0
        while True:
            reduced = cost[i] - row[i] - column + shift
            better = ~done & (reduced < slack)
            slack[better], via[better] = reduced[better], j
            j = int(np.where(done, np.inf, slack).argmin())
            shift, done[j] = slack[j], True
            if match[j] < 0:
                break
            i = match[j]
        for k in np.flatnonzero(done):
            if match[k] >= 0:
                row[match[k]] += shift - slack[k]
            column[k] -= shift - slack[k]
        row[start] += shift
        while j >= 0:
            before = via[j]
            match[j] = match[before] if before >= 0 else start
            j = before
    return [(int(match[j]), j) for j in range(m) if match[j] >= 0]


def best_assignment(parts: DataFrame, a: str, b: str, weight: str, most: int = 2_000) -> DataFrame:
    """Classes of ``a`` assigned to classes of ``b`` one to one; an error beyond ``most`` classes on a side."""
    t = parts.groupBy(a, b).agg(F.sum(weight).alias("w"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        wide = frame.pivot_table(index=a, columns=b, values="w", fill_value=0, aggfunc="sum").sort_index()
        if max(wide.shape, default=0) > most:
            raise ValueError(f"{max(wide.shape)} classes; at most {most} are assigned")
        got = _assign(wide.to_numpy(float))
        return pd.DataFrame([(int(wide.index[i]), wide.columns[j], int(wide.iat[i, j])) for i, j in got], columns=[a, b, "w"])

    kind = t.schema[a].dataType.simpleString()
    return t.groupBy().applyInPandas(run, f"{a} {kind}, {b} string, w long")
