"""Value harmonisation, sampling and splits (V)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed
from tessella.operators import ranks, sampling
from tessella.sources.standard import long_values, standard_cells, stored_counts, value_counts
from tessella.sources.tables import table

from .registry import L, M, U, Registry

REGISTRY = register = Registry()


def _id_hash(*parts: str) -> str:
    return f"md5(concat_ws('|', '7', {', '.join(parts)}))"


_ID = "cell_id::VARCHAR, load_id::VARCHAR, coalesce(x_px, 0)::BIGINT::VARCHAR"


@register(f"""WITH {M}, s AS (SELECT cell_id, load_id, cohort, label, coalesce(patient_id, '') AS patient, {_id_hash(_ID)} AS h FROM m WHERE cell_id IS NOT NULL),
t AS (SELECT *, row_number() OVER (PARTITION BY cohort, patient, label ORDER BY h, cell_id) AS turn FROM s)
SELECT cohort, cell_id FROM (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY turn, h, cell_id) AS rn FROM t) WHERE rn <= 200""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """V3: 200 cells of each cohort, every (patient, label) giving one per turn."""
    cells = standard_cells(spark, d).where("cell_id is not null").withColumn("patient", F.coalesce("patient_id", F.lit("")))
    return sampling.round_robin(cells, "cohort", ["patient", "label"], 200).select("cohort", "cell_id")


@register(f"WITH {M} SELECT cell_id, cohort FROM (SELECT cell_id, cohort, {_id_hash(_ID)} AS h FROM m WHERE cell_id IS NOT NULL) ORDER BY h, cell_id LIMIT 500")
def plain_sample(spark: SparkSession, d: str) -> DataFrame:
    """500 cells without replacement, in the order of a seeded hash."""
    cells = standard_cells(spark, d).where("cell_id is not null")
    return cells.select("cell_id", "cohort", sampling.seeded(7).alias("h")).orderBy("h", "cell_id").limit(500).select("cell_id", "cohort")


@register(f"""WITH {U}, s AS (SELECT DISTINCT cell_id, {_id_hash("cell_id::VARCHAR")} AS h FROM u WHERE cell_id IS NOT NULL), p AS (SELECT cell_id FROM s ORDER BY h, cell_id LIMIT 300)
SELECT cohort, marker, count(*) AS n, round(avg(u), 6) AS mean_u FROM u JOIN p USING (cell_id) GROUP BY 1, 2""")
def sample_on_full_ranks(spark: SparkSession, d: str) -> DataFrame:
    """V2: ranks come from all rows, the written table holds a sample."""
    cells = standard_cells(spark, d)
    u = ranks.mid_rank(value_counts(cells, "cohort"), ["cohort", "marker"]).select("cohort", "marker", "v", "u")
    ids = cells.where("cell_id is not null").select("cell_id").distinct().withColumn("h", F.md5(F.concat_ws("|", F.lit("7"), F.col("cell_id").cast("string")))).orderBy("h", "cell_id").limit(300).select("cell_id")
    rows = long_values(cells, "cell_id", "cohort").join(ids, "cell_id")
    return rows.join(u, ["cohort", "marker", "v"]).groupBy("cohort", "marker").agg(F.count(F.lit(1)).alias("n"), fixed(F.avg("u"), 6).alias("mean_u"))


@register(f"""WITH {U}, t AS (SELECT i * 0.1 AS level FROM range(1, 10) g(i)), s AS (SELECT cohort, marker, var_samp(u) * 12 AS s FROM u GROUP BY 1, 2)
SELECT level::DOUBLE AS level, count(*) FILTER (WHERE s < level) AS below, count(*) FILTER (WHERE s >= level) AS above FROM s, t GROUP BY 1""")
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """V6: how many (cohort, marker) pairs each threshold of the rank spread leaves out."""
    u = ranks.mid_rank(stored_counts(spark, d, "cohort"), ["cohort", "marker"])
    n, s, ss = F.sum("n"), F.sum(F.col("u") * F.col("n")), F.sum(F.col("u") * F.col("u") * F.col("n"))
    spread = u.groupBy("cohort", "marker").agg((12 * (ss - s * s / n) / F.when(n > 1, n - 1)).alias("s"))
    levels = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: i * F.lit(1.0) / 10)
    return spread.withColumn("level", F.explode(levels)).groupBy("level").agg(F.count_if(F.col("s") < F.col("level")).alias("below"), F.count_if(F.col("s") >= F.col("level")).alias("above"))


_SPLIT = f"""sl AS (SELECT DISTINCT cohort, image_id, {_id_hash("image_id")} AS h FROM m), rk AS (SELECT *, row_number() OVER (PARTITION BY cohort ORDER BY h, image_id) AS rn, count(*) OVER (PARTITION BY cohort) AS k FROM sl),
sp AS (SELECT cohort, image_id, CASE WHEN rn <= greatest(1, round_even(0.2 * k, 0)) THEN 'test' WHEN rn <= greatest(1, round_even(0.2 * k, 0)) + greatest(1, round_even(0.12 * k, 0)) THEN 'val' ELSE 'train' END AS split FROM rk)"""


@register(f"WITH {M}, {_SPLIT} SELECT cohort, image_id, split FROM sp")
def slide_split(spark: SparkSession, d: str) -> DataFrame:
    """V8: slides split 20 % test, 12 % validation, at least one each."""
    return sampling.group_split(standard_cells(spark, d), "cohort", "image_id")


@register(f"""WITH {L}, {_SPLIT}, s AS (SELECT l.cohort, marker, split, quantile_cont(v, .5) AS med, count(*) AS n FROM l JOIN sp USING (cohort, image_id) GROUP BY 1, 2, 3)
SELECT cohort, marker, split, n, round(med, 6) AS med, n >= 100 AS floor_met FROM s""")
def split_floor(spark: SparkSession, d: str) -> DataFrame:
    """The support rule applied again on each split, with its median as the baseline predictor."""
    cells = standard_cells(spark, d)
    split = sampling.group_split(cells, "cohort", "image_id")
    counts = value_counts(cells, "cohort", "image_id").join(split, ["cohort", "image_id"]).groupBy("cohort", "marker", "split", "v").agg(F.sum("n").alias("n"))
    q = ranks.quantiles(counts, ["cohort", "marker", "split"], [0.5])
    return q.select("cohort", "marker", "split", F.col("rows").alias("n"), fixed(F.col("q")[0], 6).alias("med"), (F.col("rows") >= 100).alias("floor_met"))


@register(f"""WITH {L}, g AS (SELECT cohort, label, marker, count(*) AS n, sum(v) AS s FROM l GROUP BY 1, 2, 3),
o AS (SELECT *, sum(n) OVER w - n AS rest_n, sum(s) OVER w - s AS rest_s FROM g WINDOW w AS (PARTITION BY label, marker))
SELECT cohort AS held_out, marker, count(*) AS n_labels, round(sqrt(avg((s / n - rest_s / rest_n) ** 2)), 5) AS rmse FROM o WHERE rest_n > 0 GROUP BY 1, 2""")
def loco_mean_baseline(spark: SparkSession, d: str) -> DataFrame:
    """The pooled mean of the other cohorts as predictor of each held-out cohort's label means; labels that only it has are skipped."""
    g = long_values(standard_cells(spark, d), "cohort", "label").groupBy("cohort", "label", "marker").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    w = Window.partitionBy("label", "marker")
    o = g.withColumns({"rest_n": F.sum("n").over(w) - F.col("n"), "rest_s": F.sum("s").over(w) - F.col("s")}).where("rest_n > 0")
    gap = F.col("s") / F.col("n") - F.col("rest_s") / F.col("rest_n")
    return o.groupBy(F.col("cohort").alias("held_out"), "marker").agg(F.count(F.lit(1)).alias("n_labels"), fixed(F.sqrt(F.avg(gap * gap)), 5).alias("rmse"))


@register(f"""WITH {M}, {_SPLIT}, r AS (SELECT m.cohort, split, cell_id, row_number() OVER (PARTITION BY m.cohort, split ORDER BY {_id_hash(_ID)}, cell_id) AS rn FROM m JOIN sp USING (cohort, image_id) WHERE cell_id IS NOT NULL)
SELECT cohort, split, cell_id FROM r WHERE rn <= 100""")
def capped_draw(spark: SparkSession, d: str) -> DataFrame:
    """V9: at most 100 cells of each cohort and split."""
    cells = standard_cells(spark, d).where("cell_id is not null")
    joined = cells.join(sampling.group_split(standard_cells(spark, d), "cohort", "image_id"), ["cohort", "image_id"])
    return sampling.capped(joined, ["cohort", "split"], 100).select("cohort", "split", "cell_id")


@register(f"""WITH {M}, {_SPLIT}, t AS (SELECT DISTINCT image_id FROM sp WHERE split = 'train'), b AS (SELECT m.cohort, image_id, pmod_ AS band FROM (SELECT *, (cell_id % 10) AS pmod_ FROM m WHERE cell_id IS NOT NULL) m)
SELECT b.cohort, CASE WHEN band = 0 THEN 'probe' ELSE 'fit' END AS part, count(*) AS n FROM b JOIN t USING (image_id) GROUP BY 1, 2""")
def probe_holdout(spark: SparkSession, d: str) -> DataFrame:
    """A probe part reserved first, and only cells of training slides kept."""
    cells = standard_cells(spark, d)
    train = sampling.group_split(cells, "cohort", "image_id").where("split = 'train'").select("image_id")
    kept = cells.where("cell_id is not null").join(train, "image_id", "left_semi")
    return kept.groupBy("cohort", F.when(F.col("cell_id") % 10 == 0, "probe").otherwise("fit").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@register(f"""WITH {M}, c AS (SELECT label, cell_id, row_number() OVER (PARTITION BY label ORDER BY {_id_hash(_ID)}, cell_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM m WHERE cell_id IS NOT NULL)
SELECT label, j AS draw, cell_id FROM c, range(0, 20) t(j) WHERE i = j % n""")
def balanced_draw(spark: SparkSession, d: str) -> DataFrame:
    """Twenty draws of every label, going round where it has fewer cells."""
    return sampling.balanced(standard_cells(spark, d).where("cell_id is not null"), "label", 20)


@register(f"""WITH {L}, s AS (SELECT DISTINCT cell_id, marker FROM l WHERE cell_id IS NOT NULL), r AS (SELECT cell_id, marker, row_number() OVER (PARTITION BY cell_id ORDER BY {_id_hash("cell_id::VARCHAR", "marker")}, marker) AS rn,
count(*) OVER (PARTITION BY cell_id) AS k FROM s) SELECT cell_id, marker FROM r WHERE rn <= greatest(1, round_even(0.15 * k, 0))""")
def mask_draw(spark: SparkSession, d: str) -> DataFrame:
    """15 % of each cell's markers hidden, at least one; the choice stays within the row, without a shuffle for it."""
    seen = long_values(standard_cells(spark, d).where("cell_id is not null"), "cell_id").groupBy("cell_id").agg(F.collect_set("marker").alias("have"))
    return sampling.masked(seen, "cell_id", "have", 0.15)


@register(f"""WITH {M}, i AS (SELECT cohort FROM m WHERE conf IS NOT NULL GROUP BY 1 HAVING count(DISTINCT conf) > 1)
SELECT cohort, count(*) AS n, round(avg(least(1, greatest(0, coalesce(conf, 1)))), 6) AS mean_conf FROM m WHERE cohort IN (SELECT cohort FROM i) GROUP BY 1""")
def confidence_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """Confidence only of cohorts where it says something."""
    cells = standard_cells(spark, d).select("cohort", "conf")
    informative = cells.where("conf is not null").groupBy("cohort").agg(F.min("conf").alias("lo"), F.max("conf").alias("hi")).where("lo < hi").select("cohort")
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("conf", F.lit(1.0))))
    return cells.join(informative, "cohort", "left_semi").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), fixed(F.avg(clipped), 6).alias("mean_conf"))
