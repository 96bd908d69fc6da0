"""Signatures of labels, how they are compared, and how a label finds its place among clusters.

Millions of rows are reduced to one signature per (cohort, label, marker); everything after works on labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed
from tessella.plans.materialize import cut

from . import ranks

MIN_CELLS, W_MIN, FLOOR, DELTA, FAR = 100, 0.10, 0.05, 0.05, 5.0
NODE = ["cohort", "label"]


def signatures(counts: DataFrame, least: int = MIN_CELLS) -> DataFrame:
    """Rows, mean rank and three quantiles of the rank for each (cohort, label, marker) with enough rows.

    ``counts`` has rows per cohort, label, marker and value; ranks are over the cohort's rows.  A marker that a cohort
    never measured has no row, which is not 0.
    """
    u = cut(ranks.mid_rank(counts, ["cohort", "marker"]), "ranks")
    mean = u.groupBy(*NODE, "marker").agg(F.sum("n").alias("n"), (F.sum(F.col("u") * F.col("n")) / F.sum("n")).alias("mean_u")).where(F.col("n") >= least)
    # ranks of a cohort are spread evenly, so even steps of them are good buckets
    q = ranks.quantiles(u, [*NODE, "marker"], [0.1, 0.5, 0.9], value="u", place=F.floor(F.col("u") * 64))
    return mean.join(q.drop("rows"), [*NODE, "marker"]).select(*NODE, "marker", "n", "mean_u", *[F.col("q")[i].alias(f"q{p}") for i, p in enumerate((10, 50, 90))])


def rescale(sig: DataFrame) -> DataFrame:
    """Positions centred on the median of the cohort's label means, over their range (at least FLOOR); the range is the weight."""
    w = Window.partitionBy("cohort", "marker")
    spread = F.max("mean_u").over(w) - F.min("mean_u").over(w)
    s = sig.withColumn("weight", spread).withColumn("mid", F.percentile("mean_u", F.lit(0.5)).over(w)).withColumn("scale", F.greatest("weight", F.lit(FLOOR)))
    place = {"p": "mean_u", "lo": "q10", "hi": "q90"}
    return s.select(*NODE, "marker", "n", "weight", *[((F.col(c) - F.col("mid")) / F.col("scale")).alias(k) for k, c in place.items()])


def informative_pairs(scaled: DataFrame) -> DataFrame:
    """Ordered pairs of labels, one row per marker that is informative for both: an equi-join on the marker."""
    a = scaled.select("marker", *[F.col(c).alias(f"{c}_a") for c in (*NODE, "weight", "p", "lo", "hi")])
    b = scaled.select("marker", *[F.col(c).alias(f"{c}_b") for c in (*NODE, "weight", "p", "lo", "hi")])
    w = F.least("weight_a", "weight_b")
    return a.join(b, "marker").where("cohort_a <> cohort_b or label_a <> label_b").withColumn("w", w).where(F.col("w") >= W_MIN)


PAIR = ["cohort_a", "label_a", "cohort_b", "label_b"]


def compare(scaled: DataFrame) -> DataFrame:
    """Evidence, similarity and containment of every ordered pair that shares an informative marker."""
    pairs = informative_pairs(scaled)
    wid = F.col("hi_a") - F.col("lo_a")
    inter = F.greatest(F.lit(0.0), F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b"))
    point = ((F.col("lo_a") >= F.col("lo_b") - 1e-6) & (F.col("lo_a") <= F.col("hi_b") + 1e-6)).cast("double")
    overlap = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(wid > 1e-6, inter / F.when(wid > 1e-6, wid)).otherwise(point)))
    gap = F.col("p_a") - F.col("p_b")
    agg = pairs.withColumn("o", overlap).groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("evidence"), F.sqrt(F.sum(F.col("w") * gap * gap) / F.sum("w")).alias("d"),
        F.exp(F.sum(F.col("w") * F.ln(F.greatest("o", F.lit(DELTA)))) / F.sum("w")).alias("containment"),
    )
    block = Window.partitionBy("cohort_a", "cohort_b")
    mid = F.percentile(F.when(F.col("d") > 0, F.col("d")), F.lit(0.5)).over(block)
    norm = F.col("d") / F.coalesce(mid, F.lit(1.0))
    return agg.withColumn("similarity", F.exp(-norm)).drop("d")


def distances(compared: DataFrame, k: int) -> DataFrame:
    """Symmetric distance -ln(similarity) of unordered pairs; FAR where the evidence is under ``k``."""
    back = compared.select(F.col("cohort_b").alias("cohort_a"), F.col("label_b").alias("label_a"), F.col("cohort_a").alias("cohort_b"), F.col("label_a").alias("label_b"), F.col("similarity").alias("back"))
    both = compared.join(back, PAIR).where("(cohort_a < cohort_b) or (cohort_a = cohort_b and label_a < label_b)")

    def d(c: str):
        return -F.ln(F.least(F.lit(1.0), F.greatest(F.lit(1e-6), F.col(c))))

    return both.select(*PAIR, "evidence", F.when(F.col("evidence") < k, F.lit(FAR)).otherwise((d("similarity") + d("back")) / 2).alias("distance"))


def coexpression(cells: DataFrame, markers: dict[str, str], least: int = MIN_CELLS) -> DataFrame:
    """Correlation of every two markers within each label, from sums; constant ones have no row."""
    names = sorted(markers)
    pairs = F.array(*[F.struct(F.lit(f"{a}|{b}").alias("pair"), F.col(markers[a]).alias("x"), F.col(markers[b]).alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]])
    long = cells.select(*NODE, F.inline(pairs)).where("x is not null and y is not null")
    g = long.groupBy(*NODE, "pair").agg(F.count(F.lit(1)).alias("n"), F.covar_pop("x", "y").alias("c"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    return g.where((F.col("n") >= least) & (F.col("sx") > 1e-6) & (F.col("sy") > 1e-6)).select(*NODE, "pair", (F.col("c") / (F.col("sx") * F.col("sy"))).alias("r"))


def coexpression_agreement(corr: DataFrame, least: int = 3) -> DataFrame:
    """Correlation of two labels' marker correlations over the pairs they share; at least ``least``, neither constant."""
    a = corr.select("pair", F.col("cohort").alias("cohort_a"), F.col("label").alias("label_a"), F.col("r").alias("ra"))
    b = corr.select("pair", F.col("cohort").alias("cohort_b"), F.col("label").alias("label_b"), F.col("r").alias("rb"))
    g = a.join(b, "pair").where("cohort_a < cohort_b").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.covar_pop("ra", "rb").alias("c"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"))
    return g.where((F.col("n") >= least) & (F.col("sa") > 1e-6) & (F.col("sb") > 1e-6)).select(*PAIR, "n", (F.col("c") / (F.col("sa") * F.col("sb"))).alias("agreement"))


def nesting(compared: DataFrame, members: DataFrame, k: int, contain: float = 0.75, margin: float = 0.10, most: float = 1.5) -> DataFrame:
    """Directed edges between clusters: a's spread sits inside b's, not the other way round, and the two are related."""
    m = members.select("cohort", "label", "cluster")
    of = compared.join(m.toDF("cohort_a", "label_a", "a"), ["cohort_a", "label_a"]).join(m.toDF("cohort_b", "label_b", "b"), ["cohort_b", "label_b"]).where("a <> b")
    blocks = of.groupBy("a", "b").agg(
        F.avg(F.when(F.col("evidence") >= k, F.col("containment"))).alias("c"), F.count_if(F.col("evidence") >= k).alias("pairs"), F.avg("similarity").alias("s")
    )
    back = blocks.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("c").alias("back"))
    related = -F.ln(F.greatest("s", F.lit(1e-9))) <= most
    one_way = F.col("back").isNull() | (F.col("c") - F.col("back") >= margin)
    return blocks.join(back, ["a", "b"], "left").where((F.col("c") >= contain) & related & one_way).select("a", "b", "c", "pairs")


def place(dist: DataFrame, members: DataFrame, held: str, most: float) -> DataFrame:
    """Labels of the held-out cohort in the cluster of least mean distance, NOVEL (-1) beyond ``most``; the clusters stay as they are."""
    rows = dist.where((F.col("cohort_a") == held) | (F.col("cohort_b") == held)).where("cohort_a <> cohort_b")
    ours = F.col("cohort_a") == held
    side = rows.select(F.when(ours, F.col("label_a")).otherwise(F.col("label_b")).alias("label"), F.when(ours, F.col("cohort_b")).otherwise(F.col("cohort_a")).alias("in_cohort"), F.when(ours, F.col("label_b")).otherwise(F.col("label_a")).alias("in_label"), "distance")
    m = members.where(F.col("cohort") != held).select(F.col("cohort").alias("in_cohort"), F.col("label").alias("in_label"), "cluster")
    mean = side.join(m, ["in_cohort", "in_label"]).groupBy("label", "cluster").agg(F.avg("distance").alias("distance"))
    first = mean.withColumn("rn", F.row_number().over(Window.partitionBy("label").orderBy(fixed("distance", 9), "cluster"))).where("rn = 1")
    return first.select("label", F.when((F.col("distance") <= most) & (F.col("distance") < FAR), F.col("cluster")).otherwise(-1).alias("cluster"), "distance")


def name_clusters(scaled: DataFrame, members: DataFrame) -> DataFrame:
    """Names from up to three markers that stand out high and one low; half the labels and three cohorts must have measured them."""
    m = members.select("cohort", "label", "cluster")
    centre = scaled.join(m, ["cohort", "label"]).groupBy("cluster", "marker").agg(F.avg("p").alias("c"), F.count(F.lit(1)).alias("k"))
    size = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    cohorts = scaled.groupBy("marker").agg(F.count_distinct("cohort").alias("n"))
    w = Window.partitionBy("marker")
    sd = F.stddev_pop("c").over(w)
    z = centre.join(size, "cluster").join(cohorts, "marker").withColumn("z", fixed((F.col("c") - F.avg("c").over(w)) / F.when(sd != 0, sd), 6)).where("k * 2 >= size and n >= 3 and z is not null")
    v = Window.partitionBy("cluster")
    r = z.withColumn("hi", F.row_number().over(v.orderBy(F.desc("z"), "marker"))).withColumn("lo", F.row_number().over(v.orderBy("z", "marker")))
    part = F.when((F.col("hi") <= 3) & (F.col("z") > 0.8), F.concat("marker", F.lit("+"))).when((F.col("lo") == 1) & (F.col("z") < -1.2), F.concat("marker", F.lit("-")))
    parts = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct((-F.col("z")).alias("o"), F.col("marker").alias("m"), part.alias("part")))))
    name = F.array_join(F.transform(parts, lambda x: x["part"]), " ")
    return r.groupBy("cluster").agg(name.alias("name")).select("cluster", F.when(F.col("name") == "", "nothing stands out").otherwise(F.col("name")).alias("name"))
