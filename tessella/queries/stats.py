"""Statistics and evaluation (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed
from tessella.operators import evaluation as ev
from tessella.operators import ranks, series
from tessella.sources.standard import standard_cells, stored_counts, value_counts
from tessella.sources.tables import table

from .registry import L, M, U, Registry

REGISTRY = register = Registry()

#: Labels of cells against the mapped cluster's name: the (truth, prediction) counts that most scores start from.
_TP = M + ", tp AS (SELECT m.cohort, x.cluster_name AS truth, m.label AS pred, count(*) AS n FROM m JOIN label_map x USING (cohort, label) GROUP BY 1, 2, 3)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    counts = standard_cells(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("n"))
    mapped = table(spark, d, "label_map").select("cohort", "label", F.col("cluster_name").alias("truth"))
    return counts.join(mapped, ["cohort", "label"]).select("cohort", "truth", F.col("label").alias("pred"), "n")


def _partitions(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the map with cells: cluster, label, cohort and cells as weight."""
    counts = standard_cells(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("w"))
    return counts.join(table(spark, d, "label_map").select("cohort", "label", "cluster"), ["cohort", "label"])


_PART = M + ", part AS (SELECT cohort, label, x.cluster, count(*) AS w FROM m JOIN label_map x USING (cohort, label) GROUP BY 1, 2, 3)"


@register(f"""WITH {L}, v AS (SELECT cohort, marker, v, count(*) AS n FROM l GROUP BY 1, 2, 3), t AS (SELECT cohort, marker, sum(n) AS total FROM v GROUP BY 1, 2),
p AS (SELECT a.marker, a.cohort AS a, b.cohort AS b, a.total AS ta, b.total AS tb FROM t a JOIN t b ON a.marker = b.marker AND a.cohort < b.cohort),
g AS (SELECT p.*, v.v, v.n * (v.cohort = a)::INT AS na, v.n * (v.cohort = b)::INT AS nb FROM p JOIN v ON v.marker = p.marker AND v.cohort IN (a, b)),
s AS (SELECT marker, a, b, ta, tb, v, sum(na) AS na, sum(nb) AS nb FROM g GROUP BY ALL),
k AS (SELECT marker, a, b, max(abs(ca / ta::DOUBLE - cb / tb::DOUBLE)) AS ks FROM (SELECT *, sum(na) OVER w AS ca, sum(nb) OVER w AS cb FROM s WINDOW w AS (PARTITION BY marker, a, b ORDER BY v)) GROUP BY 1, 2, 3)
SELECT marker, count(*) AS n_pairs, round(avg(ks), 6) AS mean_ks FROM k GROUP BY 1""")
def ks_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """Mean two-sample Kolmogorov-Smirnov distance over the pairs of cohorts."""
    k = ev.pairwise_ks(stored_counts(spark, d, "cohort"), "cohort", "marker")
    return k.groupBy("marker").agg(F.count(F.lit(1)).alias("n_pairs"), fixed(F.avg("ks"), 6).alias("mean_ks"))


_HALVES = f"""WITH {L}, c AS (SELECT cohort, image_id, label, count(*) AS n FROM m GROUP BY 1, 2, 3), e AS (SELECT cohort, image_id, round(-sum(p * ln(p + 1e-12)), 9) AS h FROM
(SELECT *, n / sum(n) OVER (PARTITION BY cohort, image_id)::DOUBLE AS p FROM c) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY h, image_id) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM e),
parts AS (SELECT cohort, image_id, CASE WHEN i < greatest(1, n // 10) THEN 'skewed' ELSE 'balanced' END AS part FROM r WHERE i < greatest(1, n // 10) OR i >= n // 2)"""


@register(_HALVES + """, q AS (SELECT l.cohort, label, marker, part, quantile_cont(v, .5) AS med, count(*) AS n FROM l JOIN parts USING (cohort, image_id) GROUP BY ALL HAVING count(*) >= 20)
SELECT a.cohort, a.label, a.marker, round(a.med - b.med, 6) AS contrast FROM q a JOIN q b USING (cohort, label, marker) WHERE a.part = 'skewed' AND b.part = 'balanced'""")
def skew_contrast(spark: SparkSession, d: str) -> DataFrame:
    """A label's median on one-sided slides against balanced ones."""
    cells = standard_cells(spark, d)
    parts = series.skewed_and_balanced(cells).select("cohort", "image_id", "part")
    counts = value_counts(cells, "cohort", "image_id", "label").join(parts, ["cohort", "image_id"]).groupBy("cohort", "label", "marker", "part", "v").agg(F.sum("n").alias("n"))
    q = ranks.quantiles(counts, ["cohort", "label", "marker", "part"], [0.5]).where("rows >= 20")
    side = {p: q.where(F.col("part") == p).select("cohort", "label", "marker", F.col("q")[0].alias(p)) for p in ("skewed", "balanced")}
    return side["skewed"].join(side["balanced"], ["cohort", "label", "marker"]).select("cohort", "label", "marker", fixed(F.col("skewed") - F.col("balanced"), 6).alias("contrast"))


@register(f"""WITH {U}, r AS (SELECT cohort, marker, label, u * t AS rank, t FROM (SELECT *, count(*) OVER (PARTITION BY cohort, marker) AS t FROM u)),
g AS (SELECT cohort, marker, label, count(*) AS n1, max(t) - count(*) AS n0, sum(rank) AS s FROM r GROUP BY 1, 2, 3)
SELECT cohort, marker, label, round((s - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auroc, (s - n1 * (n1 + 1) / 2.0) / (n1 * n0) >= 0.75 AS pass FROM g WHERE n1 >= 20 AND n0 >= 20""")
def auroc_rules(spark: SparkSession, d: str) -> DataFrame:
    """Area under the curve of each label against the rest by mid-ranks, with its declared bar."""
    return ev.auroc_of_labels(stored_counts(spark, d, "cohort", "label"), ["cohort", "marker"], "label", least=20, bar=0.75)


@register(f"""WITH {_TP}, s AS (SELECT cohort, c AS class, sum(n * (truth = c AND pred = c)::INT) AS hit, sum(n * (truth = c)::INT) AS t, sum(n * (pred = c)::INT) AS p
FROM (SELECT tp.*, unnest([truth, pred]) AS c, truth <> pred AS two FROM tp WHERE truth <> pred UNION ALL SELECT tp.*, truth, false FROM tp WHERE truth = pred) GROUP BY 1, 2)
SELECT cohort, class, round(hit / nullif(p, 0)::DOUBLE, 4) AS prec, round(hit / t::DOUBLE, 4) AS rec, round(2.0 * hit / (t + p), 4) AS f1 FROM s WHERE t > 0""")
def per_class_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall and F1 of the classes in the truth."""
    return ev.class_scores(_pairs(spark, d), ["cohort"]).select("cohort", "class", fixed("prec", 4).alias("prec"), fixed("rec", 4).alias("rec"), fixed("f1", 4).alias("f1"))


_F1 = _TP + """, s AS (SELECT cohort, c AS class, sum(n * (truth = c AND pred = c)::INT) AS hit, sum(n * (truth = c)::INT) AS t, sum(n * (pred = c)::INT) AS p
FROM (SELECT tp.*, unnest([truth, pred]) AS c FROM tp WHERE truth <> pred UNION ALL SELECT tp.*, truth FROM tp WHERE truth = pred) GROUP BY 1, 2), f AS (SELECT cohort, class, 2.0 * hit / (t + p) AS f1, t FROM s WHERE t > 0)"""


@register(f"WITH {_F1} SELECT cohort, count(*) AS n_classes, round(avg(f1), 6) AS macro_f1, round(avg(CASE WHEN t >= 100 THEN f1 END), 6) AS macro_learnable FROM f GROUP BY 1")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    """Macro-F1 over classes in the truth, and over those with enough rows."""
    s = ev.class_scores(_pairs(spark, d), ["cohort"])
    return s.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_classes"), fixed(F.avg("f1"), 6).alias("macro_f1"), fixed(F.avg(F.when(F.col("support") >= 100, F.col("f1"))), 6).alias("macro_learnable"))


@register(f"WITH {_TP}, c AS (SELECT cohort, truth, sum(n) AS n FROM tp GROUP BY 1, 2) SELECT cohort, round(max(n) / sum(n)::DOUBLE, 6) AS majority, round(sum(n * n) / (sum(n) * sum(n))::DOUBLE, 6) AS chance, round(sum(n::DOUBLE / total * log2(total / n)), 6) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY cohort)::DOUBLE AS total FROM c) GROUP BY 1")
def baselines(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the majority class and of chance, and the bits a class holds."""
    c = _pairs(spark, d).groupBy("cohort", "truth").agg(F.sum("n").alias("n"))
    return ev.chance_levels(c, "cohort", "n")


@register(f"""WITH {L}, c AS (SELECT cohort, label, marker, avg(v) AS mean, count(*) AS n, sum(v * v) AS ss, sum(v) AS s FROM l GROUP BY 1, 2, 3),
g AS (SELECT cohort, marker, sum(ss) - 2 * sum(mean * s) + sum(n * mean * mean) AS sse, sum(ss) - sum(s) * sum(s) / sum(n) AS sst FROM c GROUP BY 1, 2)
SELECT cohort, marker, round(CASE WHEN sst > 1e-12 THEN 1 - sse / sst END, 5) AS r2 FROM g""")
def r2_masked(spark: SparkSession, d: str) -> DataFrame:
    """Share of a marker's variance that the label's mean explains, from sums alone."""
    return ev.explained_by(stored_counts(spark, d, "cohort", "label"), ["cohort", "marker"], "label")


_ARI = """, t AS (SELECT {a} AS a, {b} AS b, sum({w}) AS n FROM part GROUP BY 1, 2), r AS (SELECT sum(n) AS n FROM t GROUP BY a), k AS (SELECT sum(n) AS n FROM t GROUP BY b),
x AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS ij, (SELECT sum(n * (n - 1) / 2.0) FROM r) AS i, (SELECT sum(n * (n - 1) / 2.0) FROM k) AS j, (SELECT sum(n) * (sum(n) - 1) / 2.0 FROM t) AS c)
SELECT round(CASE WHEN (i + j) / 2 - i * j / c <> 0 THEN (ij - i * j / c) / ((i + j) / 2 - i * j / c) ELSE 0 END, 6) AS ari FROM x"""


@register("WITH " + _PART + _ARI.format(a="cluster", b="label", w="w::DOUBLE"))
def ari(spark: SparkSession, d: str) -> DataFrame:
    """Adjusted Rand index of clusters and labels, weighted by cells."""
    return ev.adjusted_rand(_partitions(spark, d), "cluster", "label", "w")


@register(f"WITH {_PART}, z AS (SELECT cluster, count(DISTINCT cohort) AS k, sum(w) AS w FROM part GROUP BY 1) SELECT round(sum(CASE WHEN k > 1 THEN w ELSE 0 END) / sum(w)::DOUBLE, 6) AS shared_cells, count(*) FILTER (WHERE k > 1) AS n_shared, count(*) AS n_clusters FROM z")
def cohort_guard(spark: SparkSession, d: str) -> DataFrame:
    """Share of cells in clusters of more than one cohort."""
    z = _partitions(spark, d).groupBy("cluster").agg(F.count_distinct("cohort").alias("k"), F.sum("w").alias("w"))
    return z.agg(fixed(F.sum(F.when(F.col("k") > 1, F.col("w")).otherwise(0)) / F.sum("w"), 6).alias("shared_cells"), F.count_if(F.col("k") > 1).alias("n_shared"), F.count(F.lit(1)).alias("n_clusters"))


@register(f"""WITH {_PART}, t AS (SELECT cluster AS a, label AS b, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2), s AS (SELECT sum(n) AS n FROM t), r AS (SELECT a, sum(n) AS n FROM t GROUP BY 1), k AS (SELECT b, sum(n) AS n FROM t GROUP BY 1),
h AS (SELECT (SELECT -sum(r.n / s.n * ln(r.n / s.n)) FROM r, s) AS ha, (SELECT -sum(k.n / s.n * ln(k.n / s.n)) FROM k, s) AS hb, (SELECT -sum(t.n / s.n * ln(t.n / s.n)) FROM t, s) AS hab)
SELECT round(2 * (ha + hb - hab) / (ha + hb), 6) AS nmi, round((ha + hb - hab) / ha, 6) AS homogeneity, round((ha + hb - hab) / hb, 6) AS completeness, round(2 * (ha + hb - hab) / (ha + hb), 6) AS v FROM h""")
def nmi_family(spark: SparkSession, d: str) -> DataFrame:
    """Normalised mutual information, homogeneity, completeness, V."""
    return ev.information(_partitions(spark, d), "cluster", "label")


@register(f"""WITH {_PART}, p AS (SELECT (a.cluster = b.cluster) AS ca, (a.label = b.label) AS cb FROM part a JOIN part b ON (a.cohort, a.label) < (b.cohort, b.label))
SELECT count(*) AS n_pairs, round(avg((ca = cb)::INT), 6) AS agreement, count(*) FILTER (WHERE ca AND cb) AS both FROM p""")
def pair_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two partitions over all pairs, from the contingency table instead of the pairs."""
    return ev.pair_counts(_partitions(spark, d), "cluster", "label")


@register(f"WITH {_PART} SELECT label, count(DISTINCT cluster) AS n_clusters, string_agg(DISTINCT cluster::VARCHAR, ',' ORDER BY cluster::VARCHAR) AS clusters FROM part GROUP BY 1 HAVING count(DISTINCT cluster) > 1")
def refine_violations(spark: SparkSession, d: str) -> DataFrame:
    """Labels that span several clusters."""
    s = _partitions(spark, d).groupBy("label").agg(F.count_distinct("cluster").alias("n_clusters"), F.array_join(F.array_sort(F.collect_set(F.col("cluster").cast("string"))), ",").alias("clusters"))
    return s.where("n_clusters > 1")


@register(f"""WITH {_TP}, ok AS (SELECT cohort, truth, sum(CASE WHEN truth = pred THEN n ELSE 0 END) / sum(n)::DOUBLE AS x FROM tp GROUP BY 1, 2),
i AS (SELECT cohort, x, row_number() OVER (PARTITION BY cohort ORDER BY truth) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM ok),
b AS (SELECT a.cohort, s, avg(i.x) AS m FROM i a, range(0, 200) t(s), i WHERE i.cohort = a.cohort AND i.i = ('0x' || substr(md5(s::VARCHAR || '|' || a.i::VARCHAR), 1, 8))::BIGINT % a.n GROUP BY 1, 2)
SELECT cohort, round(quantile_cont(m, .025), 6) AS low, round(quantile_cont(m, .975), 6) AS high FROM b GROUP BY 1""")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Percentile interval of mean class recall over 200 resamples, drawn by hash."""
    ok = _pairs(spark, d).groupBy("cohort", "truth").agg((F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)) / F.sum("n")).alias("x"))
    return ev.bootstrap(ok, "cohort", "truth", "x", 200)


@register(f"""WITH {_PART}, i AS (SELECT cluster, label, row_number() OVER (ORDER BY cohort, label) AS i FROM part), r AS (SELECT s, i, cluster, row_number() OVER (PARTITION BY s ORDER BY md5(s::VARCHAR || '|' || i::VARCHAR), i) AS j FROM i, range(0, 100) t(s)),
p AS (SELECT s, r.cluster AS a, i.label AS b, count(*)::DOUBLE AS n FROM r JOIN i ON i.i = r.j GROUP BY ALL), e AS (SELECT s, sum(n * (n - 1)) AS same FROM p GROUP BY 1),
o AS (SELECT sum(n * (n - 1)) AS same FROM (SELECT cluster, label, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2))
SELECT o.same AS observed, round((1 + count(*) FILTER (WHERE e.same >= o.same)) / 101.0, 6)::DOUBLE AS p_value, quantile_cont(e.same, .999) AS top FROM e, o GROUP BY ALL""")
def perm_null(spark: SparkSession, d: str) -> DataFrame:
    """Permutation null of the pairs that clusters and labels share."""
    return ev.permutation(_partitions(spark, d), ["cohort", "label"], "cluster", "label", 100)


@register(f"""WITH {_F1}, k AS (SELECT truth AS class, count(DISTINCT cohort) AS k FROM tp GROUP BY 1)
SELECT CASE WHEN k <= 1 THEN '1' WHEN k <= 3 THEN '2-3' ELSE '4+' END AS band, count(*) AS n, round(avg(f1), 6) AS mean_f1, round(avg((f1 = 0)::INT), 6) AS share_zero FROM f JOIN k USING (class) GROUP BY 1""")
def support_bands(spark: SparkSession, d: str) -> DataFrame:
    """F1 by the number of cohorts that contribute to a class."""
    p = _pairs(spark, d)
    k = p.groupBy(F.col("truth").alias("class")).agg(F.count_distinct("cohort").alias("k"))
    s = ev.class_scores(p, ["cohort"]).join(k, "class")
    band = F.when(F.col("k") <= 1, "1").when(F.col("k") <= 3, "2-3").otherwise("4+")
    return s.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), fixed(F.avg("f1"), 6).alias("mean_f1"), fixed(F.avg((F.col("f1") == 0).cast("int")), 6).alias("share_zero"))


@register(f"WITH {_TP}, m1 AS (SELECT cohort, pred, truth, sum(n) AS n FROM tp GROUP BY ALL) SELECT cohort, round(sum(top) / sum(total)::DOUBLE, 6) AS agreement FROM (SELECT cohort, pred, max(n) AS top, sum(n) AS total FROM m1 GROUP BY 1, 2) GROUP BY 1")
def majority_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Every predicted class taken as its most common truth."""
    return ev.many_to_one(_pairs(spark, d), ["cohort"])


@register(f"""WITH {_F1}, r AS (SELECT cohort, f1, row_number() OVER (PARTITION BY cohort ORDER BY f1 DESC, class) AS rank FROM f)
SELECT a.cohort AS cohort_a, b.cohort AS cohort_b, count(*) AS n, round(avg(a.f1 - b.f1), 6) AS mean_gap FROM r a JOIN r b USING (rank) WHERE a.cohort < b.cohort GROUP BY 1, 2""")
def rank_aligned(spark: SparkSession, d: str) -> DataFrame:
    """Classes of two cohorts compared rank by rank."""
    return ev.rank_aligned_gaps(ev.class_scores(_pairs(spark, d), ["cohort"]))


@register(f"WITH {_PART}, c AS (SELECT cluster, sum(w) AS total, max(w) AS most FROM part GROUP BY 1) SELECT p.cohort, p.label, p.cluster, p.w, c.most, p.w * 20 < c.most AS swallowed FROM part p JOIN c USING (cluster) WHERE p.w < 200")
def rare_swallow(spark: SparkSession, d: str) -> DataFrame:
    """Rare labels in the cluster of a much larger one."""
    p = _partitions(spark, d)
    c = p.groupBy("cluster").agg(F.max("w").alias("most"))
    return p.where("w < 200").join(c, "cluster").select("cohort", "label", "cluster", "w", "most", (F.col("w") * 20 < F.col("most")).alias("swallowed"))


@register(f"""WITH {L}, q AS (SELECT marker, x.unreliable AS flagged, quantile_cont(v, .5) AS med, quantile_cont(v, .75) - quantile_cont(v, .25) AS iqr FROM l JOIN label_map x USING (cohort, label) GROUP BY 1, 2)
SELECT a.marker, round(a.med - b.med, 6) AS median_gap, round(a.iqr / nullif(b.iqr, 0), 6) AS iqr_ratio FROM q a JOIN q b USING (marker) WHERE NOT a.flagged AND b.flagged""")
def kept_vs_excluded(spark: SparkSession, d: str) -> DataFrame:
    """Values of kept labels against those of flagged ones."""
    flags = table(spark, d, "label_map").select("cohort", "label", F.col("unreliable").alias("flagged"))
    counts = stored_counts(spark, d, "cohort", "label").join(flags, ["cohort", "label"]).groupBy("marker", "flagged", "v").agg(F.sum("n").alias("n"))
    q = ranks.quantiles(counts, ["marker", "flagged"], [0.25, 0.5, 0.75]).select("marker", "flagged", F.col("q")[1].alias("med"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
    b = q.where("flagged").select("marker", F.col("med").alias("med_b"), F.col("iqr").alias("iqr_b"))
    ratio = F.col("iqr") / F.when(F.col("iqr_b") != 0, F.col("iqr_b"))
    return q.where("not flagged").join(b, "marker").select("marker", fixed(F.col("med") - F.col("med_b"), 6).alias("median_gap"), fixed(ratio, 6).alias("iqr_ratio"))


@register("WITH " + _PART.replace("x.cluster, count(*)", "CASE WHEN x.unreliable THEN -1 ELSE x.cluster END AS cluster, count(*)") + _ARI.format(a="cluster", b="label", w="w::DOUBLE"))
def relabel_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """The index with flagged labels put into one class."""
    flags = table(spark, d, "label_map").select("cohort", "label", "unreliable")
    p = _partitions(spark, d).join(flags, ["cohort", "label"]).withColumn("cluster", F.when(F.col("unreliable"), -1).otherwise(F.col("cluster")))
    return ev.adjusted_rand(p, "cluster", "label", "w")


@register(f"WITH {M} SELECT cohort, count(*) AS n, count(*) FILTER (WHERE x.cluster IS NULL) AS unmapped, count(*) FILTER (WHERE x.cluster = -1) AS novel FROM m LEFT JOIN label_map x USING (cohort, label) GROUP BY 1")
def scored_holdout(spark: SparkSession, d: str) -> DataFrame:
    """Rows without a class, counted before they are dropped or kept as novel."""
    counts = standard_cells(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("n"))
    j = counts.join(table(spark, d, "label_map").select("cohort", "label", "cluster"), ["cohort", "label"], "left")
    return j.groupBy("cohort").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("cluster").isNull(), F.col("n")).otherwise(0)).alias("unmapped"), F.sum(F.when(F.col("cluster") == -1, F.col("n")).otherwise(0)).alias("novel"))


@register(f"""WITH {L}, g AS (SELECT cohort, label, x.cluster, marker, avg(v) AS mean FROM l JOIN label_map x USING (cohort, label) GROUP BY 1, 2, 3, 4),
w AS (SELECT marker, cluster, var_pop(mean) AS within, avg(mean) AS c, count(*) AS n FROM g GROUP BY 1, 2)
SELECT marker, round(avg(CASE WHEN n > 1 THEN within END), 5) AS within, round(var_pop(c), 5) AS between_, avg(CASE WHEN n > 1 THEN within END) < var_pop(c) AS coherent FROM w GROUP BY 1""")
def coherence(spark: SparkSession, d: str) -> DataFrame:
    """Variance within clusters against between them."""
    counts = stored_counts(spark, d, "cohort", "label").groupBy("cohort", "label", "marker").agg((F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    g = counts.join(table(spark, d, "label_map").select("cohort", "label", "cluster"), ["cohort", "label"])
    w = g.groupBy("marker", "cluster").agg(F.var_pop("mean").alias("within"), F.avg("mean").alias("c"), F.count(F.lit(1)).alias("n"))
    inside = F.avg(F.when(F.col("n") > 1, F.col("within")))
    return w.groupBy("marker").agg(fixed(inside, 5).alias("within"), fixed(F.var_pop("c"), 5).alias("between_"), (inside < F.var_pop("c")).alias("coherent"))


@register()
def hungarian(spark: SparkSession, d: str) -> DataFrame:
    """The one-to-one assignment of clusters to labels with the greatest agreement (no SQL)."""
    return ev.best_assignment(_partitions(spark, d), "cluster", "label", "w")
