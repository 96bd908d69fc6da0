"""Window functions, sorts and top-k (E, F)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed
from tessella.operators import ranks, series
from tessella.operators.matching import standard_profiles
from tessella.plans.joins import skew_join
from tessella.plans.materialize import cut
from tessella.sources.standard import long_values, standard_cells, stored_counts
from tessella.sources.tables import table

from .registry import L, M, U, Registry

REGISTRY = register = Registry()


def _brought_back(rows: DataFrame, group: list[str]) -> DataFrame:
    """Every row with its mid-rank ``u``; a value that many rows share is no hot key."""
    counts = cut(rows.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n")), "counts")
    u = cut(ranks.mid_rank(counts, group).select(*group, "v", "n", fixed("u", 8).alias("u")), "ranks")
    return skew_join(rows, u, [*group, "v"], F.col("cell_id"), hits="n")


def _cohort_ranks(rows: DataFrame) -> DataFrame:
    return _brought_back(rows, ["cohort", "marker"]).select("cell_id", "cohort", "marker", "v", "u")


@register(f"WITH {U} SELECT cell_id, cohort, marker, v, round(u, 8) AS u FROM u")
def ecdf_cohort(spark: SparkSession, d: str) -> DataFrame:
    """Mid-rank within cohort and marker, for every marker, brought back to every row."""
    return _cohort_ranks(long_values(standard_cells(spark, d), "cell_id", "cohort"))


@register(f"WITH {U} SELECT cohort, marker, v, count(*) AS n, round(max(u), 8) AS u FROM u GROUP BY 1, 2, 3")
def ecdf_cohort_all(spark: SparkSession, d: str) -> DataFrame:
    """The same with one row for each distinct value."""
    counts = stored_counts(spark, d, "cohort")
    return ranks.mid_rank(counts, ["cohort", "marker"]).select("cohort", "marker", "v", "n", fixed("u", 8).alias("u"))


@register(f"""WITH {L}, r AS (SELECT *, (rank() OVER (PARTITION BY image_id, marker ORDER BY v) + (count(*) OVER (PARTITION BY image_id, marker, v) - 1) / 2.0) / count(*) OVER (PARTITION BY image_id, marker) AS u FROM l)
SELECT image_id, marker, v, round(max(u), 8) AS u, count(*) AS n FROM r GROUP BY 1, 2, 3""")
def ecdf_image(spark: SparkSession, d: str) -> DataFrame:
    """Mid-rank within the slide for every marker, one row for each distinct value."""
    counts = stored_counts(spark, d, "image_id")
    return ranks.mid_rank(counts, ["image_id", "marker"]).select("image_id", "marker", "v", fixed("u", 8).alias("u"), "n")


@register(f"""WITH {L}, r AS (SELECT *, (rank() OVER (PARTITION BY image_id, marker ORDER BY v) + (count(*) OVER (PARTITION BY image_id, marker, v) - 1) / 2.0) / count(*) OVER (PARTITION BY image_id, marker) AS u FROM l)
SELECT cell_id, image_id, marker, v, round(u, 8) AS u FROM r""")
def ecdf_image_all(spark: SparkSession, d: str) -> DataFrame:
    """The same brought back to every row."""
    rows = long_values(standard_cells(spark, d), "cell_id", "image_id")
    return _brought_back(rows, ["image_id", "marker"]).select("cell_id", "image_id", "marker", "v", "u")


@register("SELECT registry_id, row_number() OVER (PARTITION BY panel_id ORDER BY registry_id) - 1 AS k FROM marker_registry WHERE panel_id IS NOT NULL")
def cumcount(spark: SparkSession, d: str) -> DataFrame:
    """Ordinal within the panel, from 0."""
    w = Window.partitionBy("panel_id").orderBy("registry_id")
    return table(spark, d, "marker_registry").where("panel_id is not null").select("registry_id", (F.row_number().over(w) - 1).alias("k"))


@register(f"""WITH {L}, s AS (SELECT cohort, image_id, marker, quantile_cont(v, .5) AS med, quantile_cont(v, .75) - quantile_cont(v, .25) AS iqr FROM l GROUP BY 1, 2, 3)
SELECT cohort, image_id, marker, round((med - avg(med) OVER w) / coalesce(nullif(stddev_samp(med) OVER w, 0), 1), 5) AS med_z,
round((iqr - avg(iqr) OVER w) / coalesce(nullif(stddev_samp(iqr) OVER w, 0), 1), 5) AS iqr_z FROM s WINDOW w AS (PARTITION BY cohort, marker)""")
def slide_stats(spark: SparkSession, d: str) -> DataFrame:
    """Slide medians and ranges, standardised within the cohort."""
    q = ranks.quantiles(stored_counts(spark, d, "cohort", "image_id"), ["cohort", "image_id", "marker"], [0.25, 0.5, 0.75])
    s = q.select("cohort", "image_id", "marker", F.col("q")[1].alias("med"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))
    w = Window.partitionBy("cohort", "marker")

    def z(c: str):
        spread = F.stddev_samp(c).over(w)
        return fixed((F.col(c) - F.avg(c).over(w)) / F.coalesce(F.when(spread != 0, spread), F.lit(1.0)), 5).alias(f"{c}_z")

    return s.select("cohort", "image_id", "marker", z("med"), z("iqr"))


@register(f"""WITH {L}, g AS (SELECT cohort, label, marker, avg(v) AS mean FROM l GROUP BY ALL HAVING count(*) >= 50),
z AS (SELECT cohort, label, marker, round((mean - avg(mean) OVER w) / nullif(stddev_pop(mean) OVER w, 0), 6) AS z FROM g WINDOW w AS (PARTITION BY cohort, marker)),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort, label ORDER BY z DESC, marker) AS hi, row_number() OVER (PARTITION BY cohort, label ORDER BY z, marker) AS lo FROM z WHERE z IS NOT NULL)
SELECT cohort, label, marker, z, CASE WHEN z > 0.8 AND hi <= 3 THEN '+' ELSE '-' END AS sign FROM r WHERE (z > 0.8 AND hi <= 3) OR (z < -1.2 AND lo = 1)""")
def zscore_topk(spark: SparkSession, d: str) -> DataFrame:
    """Markers that stand out of a label, up to three high and one low."""
    z = standard_profiles(stored_counts(spark, d, "cohort", "label"), ["cohort"], "label", least=50).withColumn("z", fixed("z", 6))
    w = Window.partitionBy("cohort", "label")
    ranked = z.withColumn("hi", F.row_number().over(w.orderBy(F.desc("z"), "marker"))).withColumn("lo", F.row_number().over(w.orderBy("z", "marker")))
    high = (F.col("z") > 0.8) & (F.col("hi") <= 3)
    return ranked.where(high | ((F.col("z") < -1.2) & (F.col("lo") == 1))).select("cohort", "label", "marker", "z", F.when(high, "+").otherwise("-").alias("sign"))


@register(f"""WITH {M}, s AS (SELECT cohort, load_id, avg(conf) AS c FROM m GROUP BY 1, 2), g AS (SELECT *, c - lag(c) OVER (PARTITION BY cohort ORDER BY load_id) AS step FROM s)
SELECT cohort, count(step) AS n_steps, coalesce(bool_and(step <= 1e-9), true) AS falling, round(arg_max(c, load_id) - arg_min(c, load_id), 6) AS change FROM g GROUP BY 1""")
def lag_monotone(spark: SparkSession, d: str) -> DataFrame:
    """Steps between loads, whether they all fall, and the change from first to last."""
    s = standard_cells(spark, d).groupBy("cohort", "load_id").agg(F.avg("conf").alias("c"))
    step = F.col("c") - F.lag("c").over(Window.partitionBy("cohort").orderBy("load_id"))
    g = s.withColumn("step", step).groupBy("cohort")
    return g.agg(F.count("step").alias("n_steps"), F.coalesce(F.bool_and(F.col("step") <= 1e-9), F.lit(True)).alias("falling"), fixed(F.max_by("c", "load_id") - F.min_by("c", "load_id"), 6).alias("change"))


@register(f"""WITH {M}, k AS (SELECT m.cohort, m.label, conf, x.cluster_name = m.label AS ok FROM m JOIN label_map x USING (cohort, label) WHERE conf IS NOT NULL),
c AS (SELECT cohort, conf, count(*) AS n, count(*) FILTER (WHERE ok) AS hit FROM k GROUP BY 1, 2),
p AS (SELECT *, sum(n) OVER (PARTITION BY cohort ORDER BY conf DESC) AS upto, sum(hit) OVER (PARTITION BY cohort ORDER BY conf DESC) AS hits, sum(n) OVER (PARTITION BY cohort) AS total FROM c),
v AS (SELECT i / 20.0 AS level FROM range(1, 21) t(i))
SELECT cohort, level::DOUBLE AS level, min(upto)::BIGINT AS n_kept, round(arg_min(hits, upto) / min(upto)::DOUBLE, 6) AS accuracy FROM p, v WHERE upto >= greatest(1, ceil(level * total)) GROUP BY 1, 2""")
def coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    """Accuracy of the most confident part at twenty levels, whole ties included."""
    k = standard_cells(spark, d).where("conf is not null").groupBy("cohort", "label", "conf").agg(F.count(F.lit(1)).alias("n"))
    mapped = k.join(table(spark, d, "label_map").select("cohort", "label", "cluster_name"), ["cohort", "label"])
    c = mapped.groupBy("cohort", "conf").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("cluster_name") == F.col("label"), F.col("n")).otherwise(0)).alias("hit"))
    return series.coverage(c, "cohort", "conf", [i / 20 for i in range(1, 21)])


@register(f"""WITH {U}, g AS (SELECT cohort, label, marker, avg(u) AS m FROM u GROUP BY 1, 2, 3 HAVING count(*) >= 50),
p AS (SELECT h.cohort AS held_out, label, marker, avg(m) AS p FROM (SELECT DISTINCT cohort FROM g) h JOIN g ON g.cohort <> h.cohort GROUP BY 1, 2, 3),
r AS (SELECT g.cohort, g.label, p.label AS said, round(avg((m - p) ** 2), 9) AS d FROM g JOIN p ON p.held_out = g.cohort AND p.marker = g.marker GROUP BY 1, 2, 3 HAVING count(*) >= 3),
b AS (SELECT cohort, label, arg_min(said, (d, said)) AS said FROM r GROUP BY 1, 2)
SELECT cohort AS held_out, count(*) AS n_labels, count(*) FILTER (WHERE label = said) AS n_right FROM b GROUP BY 1""")
def loco_profiles(spark: SparkSession, d: str) -> DataFrame:
    """Each cohort held out, its labels named by the nearest mean profile of the other cohorts, all in one job."""
    u = ranks.mid_rank(stored_counts(spark, d, "cohort", "label"), ["cohort", "marker"])
    g = cut(u.groupBy("cohort", "label", "marker").agg(F.sum("n").alias("n"), (F.sum(F.col("u") * F.col("n")) / F.sum("n")).alias("m")).where("n >= 50"), "profiles")
    # what the other cohorts make of a label is the total less the held-out cohort's part
    total = g.groupBy(F.col("label").alias("said"), "marker").agg(F.sum("m").alias("s"), F.count(F.lit(1)).alias("k"))
    own = g.select(F.col("cohort").alias("held_out"), F.col("label").alias("said"), "marker", F.col("m").alias("own"))
    p = g.select(F.col("cohort").alias("held_out"), "label", "marker", "m").join(total, "marker").join(own, ["held_out", "said", "marker"], "left")
    left = F.col("k") - F.when(F.col("own").isNull(), 0).otherwise(1)
    gap = F.col("m") - (F.col("s") - F.coalesce("own", F.lit(0.0))) / F.col("left")
    near = p.withColumn("left", left).where("left > 0").groupBy("held_out", "label", "said")
    r = near.agg(F.count(F.lit(1)).alias("shared"), fixed(F.avg(F.pow(gap, 2)), 9).alias("d")).where("shared >= 3")
    best = r.groupBy("held_out", "label").agg(F.min(F.struct("d", "said"))["said"].alias("said"))
    return best.groupBy("held_out").agg(F.count(F.lit(1)).alias("n_labels"), F.count_if(F.col("label") == F.col("said")).alias("n_right"))


@register(f"""WITH {M}, s AS (SELECT cohort, load_id, round(avg(area_px2), 6) AS x FROM m WHERE area_px2 IS NOT NULL GROUP BY 1, 2),
b AS (SELECT *, min(x) OVER (PARTITION BY cohort ORDER BY load_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best, row_number() OVER (PARTITION BY cohort ORDER BY load_id) AS i FROM s),
f AS (SELECT *, max(CASE WHEN best IS NULL OR x < best THEN i END) OVER (PARTITION BY cohort ORDER BY load_id) AS last_good FROM b)
SELECT cohort, min(load_id) AS stop_load FROM f WHERE i - last_good >= 2 GROUP BY 1""")
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """The load at which a series has not improved for two steps."""
    s = standard_cells(spark, d).where("area_px2 is not null").groupBy("cohort", "load_id").agg(fixed(F.avg("area_px2"), 6).alias("x"))
    return series.patience(s, "cohort", "load_id", "x", 2).groupBy("cohort").agg(F.min("load_id").alias("stop_load"))


@register("SELECT kind, symbol, rn FROM (SELECT kind, symbol, row_number() OVER (PARTITION BY kind ORDER BY length(full_name) DESC, symbol) AS rn FROM marker_reference) WHERE rn <= 5")
def sort_topk(spark: SparkSession, d: str) -> DataFrame:
    """a mixed-direction sort, and the first five of each kind."""
    w = Window.partitionBy("kind").orderBy(F.desc(F.length("full_name")), "symbol")
    return table(spark, d, "marker_reference").select("kind", "symbol", F.row_number().over(w).alias("rn")).where("rn <= 5")


@register(f"""WITH {M}, c AS (SELECT cohort, image_id, label, count(*) AS n FROM m GROUP BY 1, 2, 3), e AS (SELECT cohort, image_id, round(-sum(p * ln(p + 1e-12)), 9) AS h FROM
(SELECT *, n / sum(n) OVER (PARTITION BY cohort, image_id)::DOUBLE AS p FROM c) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY h, image_id) - 1 AS i, count(*) OVER (PARTITION BY cohort) AS n FROM e)
SELECT cohort, image_id, CASE WHEN i < greatest(1, n // 10) THEN 'skewed' ELSE 'balanced' END AS part FROM r WHERE i < greatest(1, n // 10) OR i >= n // 2""")
def decile_halves(spark: SparkSession, d: str) -> DataFrame:
    """slides of the lowest entropy decile and of the upper half."""
    return series.skewed_and_balanced(standard_cells(spark, d)).select("cohort", "image_id", "part")


@register("""SELECT *, row_number() OVER (PARTITION BY kind ORDER BY CASE WHEN gene = '' THEN 1000000 ELSE length(gene) END, n DESC, gene) AS rank
FROM (SELECT kind, coalesce(gene, '') AS gene, count(*) AS n FROM marker_registry WHERE kind IS NOT NULL GROUP BY ALL)""")
def ranked_missing_last(spark: SparkSession, d: str) -> DataFrame:
    """a two-key order in which a missing key comes last."""
    g = table(spark, d, "marker_registry").where("kind is not null").groupBy("kind", F.coalesce("gene", F.lit("")).alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    key = F.when(F.col("gene") == "", 1_000_000).otherwise(F.length("gene"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(key, F.desc("n"), "gene")))


@register(f"""WITH {M}, t AS (SELECT i * 0.1 AS cut FROM range(1, 10) g(i)), s AS (SELECT cohort, cut, abs(count(*) FILTER (WHERE conf < cut) / count(*)::DOUBLE - 0.5) AS gap FROM m, t WHERE conf IS NOT NULL GROUP BY 1, 2)
SELECT cohort, cut::DOUBLE AS cut, round(gap, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY round(gap, 9), cut) AS rn FROM s) WHERE rn = 1""")
def argmax_smallest(spark: SparkSession, d: str) -> DataFrame:
    """the parameter with the best score, the smaller of equals."""
    counts = standard_cells(spark, d).where("conf is not null").groupBy("cohort", "conf").agg(F.count(F.lit(1)).alias("n"))
    cuts = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i * F.lit(1.0) / 10)
    s = counts.withColumn("cut", F.explode(cuts)).groupBy("cohort", "cut").agg(F.abs(F.sum(F.when(F.col("conf") < F.col("cut"), F.col("n")).otherwise(0)) / F.sum("n") - 0.5).alias("gap"))
    w = Window.partitionBy("cohort").orderBy(fixed("gap", 9), "cut")
    return s.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("cohort", "cut", fixed("gap", 6).alias("gap"))
