"""Aggregations (D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed
from tessella.operators import ranks, summaries
from tessella.operators.summaries import entropy, tie_mass
from tessella.sources.standard import long_values, standard_cells, stored_counts
from tessella.sources.tables import table

from .registry import L, M, U, Registry

REGISTRY = register = Registry()


@register(f"WITH {M} SELECT label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM m GROUP BY 1")
def freq_share(spark: SparkSession, d: str) -> DataFrame:
    """Frequency and share."""
    counts = standard_cells(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("total"))).select("label", "n", fixed(100.0 * F.col("n") / F.col("total"), 6).alias("pct"))


@register(f"WITH {M} SELECT cohort, label, round(count(*) / (sum(count(*)) OVER (PARTITION BY cohort))::DOUBLE, 6) AS share FROM m GROUP BY 1, 2")
def share_in_group(spark: SparkSession, d: str) -> DataFrame:
    """Frequency normalised within the cohort."""
    counts = standard_cells(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("cohort", "label", fixed(F.col("n") / F.sum("n").over(Window.partitionBy("cohort")), 6).alias("share"))


@register(f"WITH {M} SELECT label, count(DISTINCT cohort) AS n_cohorts, count(DISTINCT image_id) AS n_images FROM m GROUP BY 1 HAVING count(DISTINCT cohort) >= 2")
def shared_by_k(spark: SparkSession, d: str) -> DataFrame:
    """D3: labels that two cohorts or more share."""
    counts = standard_cells(spark, d).select("label", "cohort", "image_id").distinct()
    return counts.groupBy("label").agg(F.count_distinct("cohort").alias("n_cohorts"), F.count_distinct("image_id").alias("n_images")).where("n_cohorts >= 2")


@register(f"WITH {M} SELECT cohort, round(avg(w), 6) AS mean_width FROM (SELECT cohort, image_id, max(x_px) - min(x_px) AS w FROM m GROUP BY 1, 2) GROUP BY 1")
def extent(spark: SparkSession, d: str) -> DataFrame:
    """Range per slide, then its mean."""
    slides = standard_cells(spark, d).groupBy("cohort", "image_id").agg((F.max("x_px") - F.min("x_px")).alias("w"))
    return slides.groupBy("cohort").agg(fixed(F.avg("w"), 6).alias("mean_width"))


@register(f"""WITH {M}, s AS (SELECT cohort, image_id, count(*) AS n FROM m GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY n, image_id) - 1 AS rn, count(*) OVER (PARTITION BY cohort) AS k, quantile_cont(n, 0.5) OVER (PARTITION BY cohort) AS med FROM s)
SELECT cohort, k AS n_images, med AS median_size, image_id AS middle_image FROM r WHERE rn = k // 2""")
def size_median(spark: SparkSession, d: str) -> DataFrame:
    """Median slide size, and the slide in the middle."""
    sizes = standard_cells(spark, d).groupBy("cohort", "image_id").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cohort")
    ranked = sizes.select("cohort", "image_id", (F.row_number().over(w.orderBy("n", "image_id")) - 1).alias("rn"), F.count(F.lit(1)).over(w).alias("n_images"), F.percentile("n", F.lit(0.5)).over(w).alias("median_size"))
    return ranked.where("rn = n_images div 2").select("cohort", "n_images", "median_size", F.col("image_id").alias("middle_image"))


@register(f"WITH {L} SELECT cohort, image_id, marker, round(quantile_cont(v, 0.5), 6) AS med, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr FROM l GROUP BY 1, 2, 3")
def group_iqr(spark: SparkSession, d: str) -> DataFrame:
    """Median and interquartile range per slide and marker."""
    q = ranks.quantiles(stored_counts(spark, d, "cohort", "image_id"), ["cohort", "image_id", "marker"], [0.25, 0.5, 0.75])
    return q.select("cohort", "image_id", "marker", fixed(F.col("q")[1], 6).alias("med"), fixed(F.col("q")[2] - F.col("q")[0], 6).alias("iqr"))


LEVELS = [0.02, 0.05, 0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.98]


@register(f"WITH {L} SELECT cohort, label, marker, count(*) AS n, " + ", ".join(f"round(quantile_cont(v, {x}), 6) AS q{int(x * 100):02d}" for x in LEVELS) + " FROM l GROUP BY 1, 2, 3")
def quantile9(spark: SparkSession, d: str) -> DataFrame:
    """Nine quantiles per label and marker."""
    q = ranks.quantiles(stored_counts(spark, d, "cohort", "label"), ["cohort", "label", "marker"], LEVELS)
    return q.select("cohort", "label", "marker", F.col("rows").alias("n"), *[fixed(F.col("q")[i], 6).alias(f"q{int(x * 100):02d}") for i, x in enumerate(LEVELS)])


@register(f"WITH {U} SELECT cohort, label, marker, round(avg(u), 6) AS mean_u FROM u GROUP BY 1, 2, 3")
def mean_rank(spark: SparkSession, d: str) -> DataFrame:
    """Mean rank per label and marker."""
    ranked = ranks.mid_rank(stored_counts(spark, d, "cohort", "label"), ["cohort", "marker"])
    return ranked.groupBy("cohort", "label", "marker").agg(fixed(F.sum(F.col("u") * F.col("n")) / F.sum("n"), 6).alias("mean_u"))


_CORR = ("raw_dnx", "raw_velk2", "raw_orsa1")


@register(f"WITH {M} SELECT cohort, label, count(*) AS n, " + ", ".join(
    f"round(CASE WHEN stddev_pop({a}) > 1e-6 AND stddev_pop({b}) > 1e-6 THEN corr({a}, {b}) END, 5) AS r_{a[4:]}_{b[4:]}" for a, b in (("raw_dnx", "raw_velk2"), ("raw_dnx", "raw_orsa1"), ("raw_velk2", "raw_orsa1"))
) + f" FROM m WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _CORR)} GROUP BY 1, 2 HAVING count(*) >= 100")
def corr_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Correlations within a label from sums, so a constant column gives NULL and no error."""
    rows = standard_cells(spark, d).where(" and ".join(f"{c} is not null" for c in _CORR))

    def r(a: str, b: str):
        var = F.var_pop(a) * F.var_pop(b)
        steady = (F.stddev_pop(a) > 1e-6) & (F.stddev_pop(b) > 1e-6)
        return fixed(F.when(steady, F.covar_pop(a, b) / F.sqrt(F.when(var > 0, var))), 5).alias(f"r_{a[4:]}_{b[4:]}")

    return rows.groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("n"), r("raw_dnx", "raw_velk2"), r("raw_dnx", "raw_orsa1"), r("raw_velk2", "raw_orsa1")).where("n >= 100")


@register(f"WITH {M} SELECT cohort, label, count(*) AS n, round(count(*) / sum(count(*)) OVER ()::DOUBLE, 8) AS prevalence FROM m GROUP BY 1, 2")
def prevalence(spark: SparkSession, d: str) -> DataFrame:
    """Prevalence over all rows."""
    counts = standard_cells(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(counts.agg(F.sum("n").alias("total"))).select("cohort", "label", "n", fixed(F.col("n") / F.col("total"), 8).alias("prevalence"))


@register(f"WITH {M} SELECT cohort, round(var_samp(conf), 6) AS var_1, round(stddev_pop(conf), 6) AS std_0 FROM m GROUP BY 1")
def sample_and_population(spark: SparkSession, d: str) -> DataFrame:
    """Sample variance and population deviation."""
    return standard_cells(spark, d).groupBy("cohort").agg(fixed(F.var_samp("conf"), 6).alias("var_1"), fixed(F.stddev_pop("conf"), 6).alias("std_0"))


@register(f"WITH {M}, c AS (SELECT cohort, raw_dnx AS v, count(*) AS n FROM m GROUP BY 1, 2) SELECT cohort, round(max(n) / sum(n)::DOUBLE, 6) AS tie_mass, count(*) AS n_values FROM c GROUP BY 1")
def tie_mass_of(spark: SparkSession, d: str) -> DataFrame:
    """Share of the most common value, NULL being a value."""
    return tie_mass(standard_cells(spark, d), ["cohort"], "raw_dnx")


@register(f"""WITH {U} SELECT cohort, marker, round(CASE WHEN quantile_cont(v, .99) - quantile_cont(v, .01) > 1e-12
THEN (quantile_cont(v, .75) - quantile_cont(v, .25)) / (quantile_cont(v, .99) - quantile_cont(v, .01)) ELSE 0 END, 6) AS dispersion,
round(var_samp(u) * 12, 6) AS rank_spread, var_samp(u) * 12 < 0.2 AS excluded FROM u GROUP BY 1, 2""")
def dynamic_range(spark: SparkSession, d: str) -> DataFrame:
    """Robust dispersion, spread of ranks, and what is left out for lack of it."""
    counts = stored_counts(spark, d, "cohort")
    q = ranks.quantiles(counts, ["cohort", "marker"], [0.01, 0.25, 0.75, 0.99])
    width = F.col("q")[3] - F.col("q")[0]
    disp = q.select("cohort", "marker", fixed(F.when(width > 1e-12, (F.col("q")[2] - F.col("q")[1]) / width).otherwise(0.0), 6).alias("dispersion"))
    u = ranks.mid_rank(counts, ["cohort", "marker"])
    n, s, ss = F.sum("n"), F.sum(F.col("u") * F.col("n")), F.sum(F.col("u") * F.col("u") * F.col("n"))
    spread = u.groupBy("cohort", "marker").agg((12 * (ss - s * s / n) / F.when(n > 1, n - 1)).alias("s"))
    return disp.join(spread, ["cohort", "marker"]).select("cohort", "marker", "dispersion", fixed("s", 6).alias("rank_spread"), (F.col("s") < 0.2).alias("excluded"))


@register(f"WITH {M} SELECT cohort, count(*) AS n, min(conf) AS low, max(conf) AS high, round(avg(CASE WHEN conf < 0.5 THEN 1 ELSE 0 END), 6) AS share_low FROM m GROUP BY ROLLUP (cohort)")
def total_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Several measures at once, with a grand total."""
    low = F.when(F.col("conf") < 0.5, 1).otherwise(0)
    return standard_cells(spark, d).rollup("cohort").agg(F.count(F.lit(1)).alias("n"), F.min("conf").alias("low"), F.max("conf").alias("high"), fixed(F.avg(low), 6).alias("share_low"))


@register(f"""WITH {M}, c AS (SELECT cohort, image_id, label, count(*) AS n FROM m GROUP BY 1, 2, 3), p AS (SELECT *, n / sum(n) OVER (PARTITION BY cohort, image_id)::DOUBLE AS p,
row_number() OVER (PARTITION BY cohort, image_id ORDER BY n DESC, label) AS rn FROM c)
SELECT cohort, image_id, round(-sum(p * ln(p + 1e-12)), 6) AS entropy, max(CASE WHEN rn = 1 THEN label END) AS dominant FROM p GROUP BY 1, 2""")
def entropy_dominant(spark: SparkSession, d: str) -> DataFrame:
    """Entropy and dominant label of each slide."""
    return entropy(standard_cells(spark, d), ["cohort", "image_id"], "label")


@register(f"WITH {M} SELECT label, string_agg(DISTINCT cohort, ', ' ORDER BY cohort) AS cohorts FROM m GROUP BY 1")
def string_agg(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct names as one text."""
    return standard_cells(spark, d).groupBy("label").agg(F.array_join(F.array_sort(F.collect_set("cohort")), ", ").alias("cohorts"))


_C = ("NORDA", "OSTEL", "PELIC", "QUARN", "RIVET", "SUNDA", "TOLVE", "UMBRA")


@register(f"WITH {L} SELECT marker, " + ", ".join(f"max(CASE WHEN cohort = '{c}' THEN 1 ELSE 0 END) AS {c.lower()}" for c in _C) + " FROM l GROUP BY 1")
def pivot_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Which cohort measured which marker; the columns are declared, so nothing is collected to find them."""
    seen = long_values(standard_cells(spark, d), "cohort").select("marker", "cohort", F.lit(1).alias("x"))
    return seen.groupBy("marker").pivot("cohort", list(_C)).agg(F.max("x")).fillna(0).withColumnsRenamed({c: c.lower() for c in _C})


@register("SELECT kind, " + ", ".join(f"count(*) FILTER (WHERE source = '{s}') AS {s}" for s in ("symbol", "alias", "prev", "manual", "unresolved")) + " FROM marker_registry WHERE kind IS NOT NULL GROUP BY 1")
def crosstab(spark: SparkSession, d: str) -> DataFrame:
    """A crosstab with guaranteed columns."""
    sources = ["symbol", "alias", "prev", "manual", "unresolved"]
    return table(spark, d, "marker_registry").where("kind is not null").groupBy("kind").pivot("source", sources).agg(F.count(F.lit(1))).fillna(0)


@register(f"""WITH {M}, c AS (SELECT cohort, coalesce(x.cluster, -1) AS cluster, count(*) AS w FROM m LEFT JOIN label_map x USING (cohort, label) GROUP BY ALL)
SELECT cohort, cluster, w, (sum(w) OVER (PARTITION BY cohort))::BIGINT AS row_total, (sum(w) OVER (PARTITION BY cluster))::BIGINT AS col_total FROM c""")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    """A weighted contingency table with its margins."""
    cells = standard_cells(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("w"))
    joined = cells.join(table(spark, d, "label_map").select("cohort", "label", "cluster"), ["cohort", "label"], "left")
    c = joined.groupBy("cohort", F.coalesce("cluster", F.lit(-1)).alias("cluster")).agg(F.sum("w").alias("w"))
    return c.withColumn("row_total", F.sum("w").over(Window.partitionBy("cohort"))).withColumn("col_total", F.sum("w").over(Window.partitionBy("cluster")))


@register(f"""WITH {M}, s AS (SELECT image_id, count(*) AS n, count(DISTINCT label) AS k FROM m GROUP BY 1)
SELECT round(corr(log10(greatest(n, 1)), k), 6) AS r, count(*) AS n_images FROM s""")
def log_correlation(spark: SparkSession, d: str) -> DataFrame:
    """Correlation of slide size (log10) and number of labels."""
    s = standard_cells(spark, d).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("image_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    return s.agg(fixed(F.corr(F.log10(F.greatest("n", F.lit(1))), "k"), 6).alias("r"), F.count(F.lit(1)).alias("n_images"))


@register(f"""WITH {M}, s AS (SELECT label, count(DISTINCT cohort) AS k, count(*) AS n FROM m GROUP BY 1)
SELECT CASE WHEN k <= 1 THEN '1' WHEN k <= 3 THEN '2-3' ELSE '4+' END AS band, count(*) AS n_labels, sum(n)::BIGINT AS n_cells FROM s GROUP BY 1""")
def binned_support(spark: SparkSession, d: str) -> DataFrame:
    """Right-closed bins; empty bins don't appear."""
    s = standard_cells(spark, d).groupBy("label", "cohort").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    band = F.when(F.col("k") <= 1, "1").when(F.col("k") <= 3, "2-3").otherwise("4+")
    return s.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n_labels"), F.sum("n").alias("n_cells"))


@register(f"WITH {M}, a AS (SELECT cohort, load_id, avg(area_px2) AS x FROM m GROUP BY 1, 2) SELECT cohort, count(x) AS n, round(avg(x), 5) AS mean, round(stddev_samp(x) / sqrt(count(x)), 5) AS sem FROM a GROUP BY 1")
def mean_sem(spark: SparkSession, d: str) -> DataFrame:
    """A mean per load first, then mean and standard error over loads."""
    a = standard_cells(spark, d).groupBy("cohort", "load_id").agg(F.avg("area_px2").alias("x"))
    n = F.count("x")
    return a.groupBy("cohort").agg(n.alias("n"), fixed(F.avg("x"), 5).alias("mean"), fixed(F.stddev_samp("x") / F.sqrt(n), 5).alias("sem"))


_T = "(1.959964 + 2.372271 / {n} + 2.822499 / ({n} * {n}) + 2.555850 / ({n} * {n} * {n}) + 1.589536 / ({n} * {n} * {n} * {n}))"


@register(f"""WITH {M}, a AS (SELECT cohort, load_id, avg(area_px2) AS x FROM m GROUP BY 1, 2), b AS (SELECT cohort, count(x) AS n, avg(x) AS mean, stddev_samp(x) / sqrt(count(x)) AS sem FROM a GROUP BY 1)
SELECT cohort, n, round(mean - sem * {_T.format(n="(n - 1.0)")}, 4) AS low, round(mean + sem * {_T.format(n="(n - 1.0)")}, 4) AS high FROM b WHERE n > 4""")
def mean_interval(spark: SparkSession, d: str) -> DataFrame:
    """The interval that holds a mean over loads in 95 of 100 cases, by Student's t."""
    a = standard_cells(spark, d).groupBy("cohort", "load_id").agg(F.avg("area_px2").alias("x"))
    b = summaries.t_interval(a, ["cohort"], "x").where("n > 4")
    return b.select("cohort", "n", fixed("low", 4).alias("low"), fixed("high", 4).alias("high"))


@register(f"""WITH {M}, a AS (SELECT cohort, load_id, avg(raw_dnx) - avg(raw_velk2) AS x FROM m GROUP BY 1, 2), b AS (SELECT cohort, count(x) AS n, avg(x) AS mean, stddev_samp(x) / sqrt(count(x)) AS sem FROM a GROUP BY 1)
SELECT cohort, n, round(mean, 5) AS mean, round(mean / nullif(sem, 0), 4) AS t, coalesce(abs(mean / nullif(sem, 0)) > {_T.format(n="(n - 1.0)")}, false) AS differs FROM b WHERE n > 4""")
def paired_test(spark: SparkSession, d: str) -> DataFrame:
    """Paired t-test of two markers' means, paired by load."""
    a = standard_cells(spark, d).groupBy("cohort", "load_id").agg((F.avg("raw_dnx") - F.avg("raw_velk2")).alias("x"))
    b = summaries.t_interval(a, ["cohort"], "x").where("n > 4").withColumn("t", F.try_divide("mean", "sem"))
    return b.select("cohort", "n", fixed("mean", 5).alias("mean"), fixed("t", 4).alias("t"), F.coalesce(F.abs("t") > F.col("t_bar"), F.lit(False)).alias("differs"))


@register(f"""WITH {M}, k AS (SELECT cohort, label, count(*) AS w FROM m GROUP BY 1, 2), j AS (SELECT w, (x.cluster_name = k.label)::INT AS ok FROM k JOIN label_map x USING (cohort, label))
SELECT round(sum(w * ok) / sum(w)::DOUBLE, 6) AS weighted, round(avg(ok), 6) AS unweighted FROM j""")
def two_accuracies(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy weighted by cells, and by labels."""
    k = standard_cells(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("w"))
    j = k.join(table(spark, d, "label_map").select("cohort", "label", "cluster_name"), ["cohort", "label"]).withColumn("ok", (F.col("cluster_name") == F.col("label")).cast("int"))
    return j.agg(fixed(F.sum(F.col("w") * F.col("ok")) / F.sum("w"), 6).alias("weighted"), fixed(F.avg("ok"), 6).alias("unweighted"))
