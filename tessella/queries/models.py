"""Prototypes, models, abstention, gates (M, S22-S24, O)."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed
from tessella.operators import evaluation as ev
from tessella.operators import gates, prototypes, sampling
from tessella.plans.materialize import broadcast_up_to, cut
from tessella.sources.standard import MARKERS, standard_cells
from tessella.sources.tables import table

from .registry import M, Registry

REGISTRY = register = Registry()
FOLDS = 5

_E = "e AS (SELECT vec_id, label, (vec_id % 5)::INT AS fold, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"
_S = _E + """, c AS (SELECT f.fold, e.label AS prototype, i, avg(x) AS c FROM e JOIN (SELECT DISTINCT fold FROM e) f ON f.fold <> e.fold GROUP BY 1, 2, 3),
s AS (SELECT vec_id, e.label, e.fold, prototype, sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))) AS cosine FROM e JOIN c USING (fold, i) GROUP BY 1, 2, 3, 4),
b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(cosine, 9) DESC, prototype) AS rn FROM s)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    e = prototypes.folds(e, FOLDS)
    return prototypes.scores(e, prototypes.held_out_centroids(e, "x", "label"))


@register(f"""WITH {_S}, tp AS (SELECT fold, label AS truth, prototype AS pred, count(*) AS n FROM b WHERE rn = 1 GROUP BY 1, 2, 3),
q AS (SELECT fold, c AS class, sum(n * (truth = c AND pred = c)::INT) AS hit, sum(n * (truth = c)::INT) AS t, sum(n * (pred = c)::INT) AS p FROM (SELECT tp.*, unnest([truth, pred]) AS c FROM tp WHERE truth <> pred UNION ALL SELECT tp.*, truth FROM tp WHERE truth = pred) GROUP BY 1, 2)
SELECT fold, count(*) AS n_classes, round(avg(2.0 * hit / (t + p)), 6) AS macro_f1 FROM q WHERE t > 0 GROUP BY 1""")
def loco_centroid(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-group-out macro-F1 of the nearest centroid, all folds in one job."""
    pairs = prototypes.best(_scored(spark, d)).groupBy("fold", F.col("label").alias("truth"), F.col("prototype").alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    s = ev.class_scores(pairs, ["fold"])
    return s.groupBy("fold").agg(F.count(F.lit(1)).alias("n_classes"), fixed(F.avg("f1"), 6).alias("macro_f1"))


GRID = [round(0.25 * i, 2) for i in range(1, 13)]


@register(f"""WITH {_S}, o AS (SELECT vec_id, max(CASE WHEN prototype = label THEN cosine END) AS own FROM s GROUP BY 1), g AS (SELECT i * 0.25 AS temperature FROM range(1, 13) t(i))
SELECT temperature::DOUBLE AS temperature, round(avg(l), 6) AS nll FROM (SELECT temperature, vec_id, ln(sum(exp((cosine - own) / temperature))) AS l FROM s JOIN o USING (vec_id), g WHERE own IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def temperature_grid(spark: SparkSession, d: str) -> DataFrame:
    """Likelihood of the right class over a grid of temperatures."""
    return prototypes.temperature_grid(_scored(spark, d), "label", GRID).withColumn("nll", fixed("nll", 6))


@register(f"WITH {_S} SELECT vec_id, round(max(cosine), 6) AS top_cosine, round(1 / sum(exp((cosine - top) / 0.5)), 6) AS top_prob FROM (SELECT *, max(cosine) OVER (PARTITION BY vec_id) AS top FROM s) GROUP BY 1")
def abstain_scores(spark: SparkSession, d: str) -> DataFrame:
    """Greatest cosine and greatest softmax probability, by which to abstain."""
    p = prototypes.softmax_by(_scored(spark, d), 0.5)
    return p.groupBy("vec_id").agg(fixed(F.max("cosine"), 6).alias("top_cosine"), fixed(F.max("prob"), 6).alias("top_prob"))


@register(f"""WITH {_S}, n AS (SELECT vec_id, label >= 8 AS novel, -round(max(CASE WHEN prototype < 8 THEN cosine END), 9) AS score FROM s GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM n)
SELECT round((sum(r) FILTER (WHERE novel) - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auroc FROM r, (SELECT count(*) FILTER (WHERE novel) AS n1, count(*) FILTER (WHERE NOT novel) AS n0 FROM n) GROUP BY n1, n0""")
def novelty_auroc(spark: SparkSession, d: str) -> DataFrame:
    """Do classes without a prototype lie further from all of them?"""
    known = F.max(F.when(F.col("prototype") < 8, F.col("cosine")))
    n = _scored(spark, d).groupBy("vec_id", (F.col("label") >= 8).alias("label")).agg((-fixed(known, 9)).alias("v"))
    counts = n.groupBy("label", "v").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(1))
    return ev.auroc_of_labels(counts, ["all"], "label", least=1, bar=0.5).where("label").select("auroc")


@register("WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(sum(x / i), 6) AS score FROM e GROUP BY 1")
def batched_predict(spark: SparkSession, d: str) -> DataFrame:
    """M9: batched linear inference."""
    weights = 1 / np.arange(1, 65, dtype=float)
    return prototypes.linear_scores(table(spark, d, "embeddings"), weights, "vec_id", "embedding").withColumn("score", fixed("score", 6))


@register("""WITH e AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), v AS (SELECT label, i, stddev_samp(x) AS s FROM e GROUP BY 1, 2)
SELECT label, round(avg(greatest(0, 1 - s)), 6) AS variance_loss FROM v GROUP BY 1""")
def loss_terms(spark: SparkSession, d: str) -> DataFrame:
    """M6: the variance term of a collapse penalty, as an aggregate."""
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    s = long.groupBy("label", "i").agg(F.stddev_samp(F.col("x").cast("double")).alias("s"))
    return s.groupBy("label").agg(fixed(F.avg(F.greatest(F.lit(0.0), 1 - F.col("s"))), 6).alias("variance_loss"))


@register()
def cohort_probe(spark: SparkSession, d: str) -> DataFrame:
    """M7: how well a multinomial logistic regression tells cohorts apart on held-out slides (no SQL)."""
    cells = standard_cells(spark, d)
    split = sampling.group_split(cells, "cohort", "image_id")
    names = [*MARKERS.values(), "conf"]
    rows = cells.join(split, ["cohort", "image_id"]).select("cohort", "split", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    codes = rows.select("cohort").distinct().select("cohort", (F.row_number().over(Window.orderBy("cohort")) - 1).cast("double").alias("code"))
    data = VectorAssembler(inputCols=names, outputCol="raw").transform(rows.join(broadcast_up_to(codes), "cohort"))
    train = data.where("split = 'train'")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    model = LogisticRegression(featuresCol="features", labelCol="code", maxIter=20, regParam=1e-3, family="multinomial").fit(scaler.transform(train))
    scored = model.transform(scaler.transform(data.where("split = 'test'")))
    return scored.groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("code")).cast("int")).alias("recall"))


@register()
def masked_marker_regression(spark: SparkSession, d: str) -> DataFrame:
    """M2: a hidden marker predicted from the others by ridge regression, each cohort held out in turn (no SQL)."""
    names = [c for c in MARKERS.values() if c != "raw_dnx"]
    cells = standard_cells(spark, d).where("raw_dnx is not null").select("cohort", "raw_dnx", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    data = VectorAssembler(inputCols=names, outputCol="features").transform(cut(cells, "masked")).select("cohort", "features", "raw_dnx")
    out = None
    for (held,) in table(spark, d, "cohorts").select("cohort").orderBy("cohort").collect():
        model = LinearRegression(featuresCol="features", labelCol="raw_dnx", regParam=0.1, solver="normal").fit(data.where(F.col("cohort") != held))
        scored = model.transform(data.where(F.col("cohort") == held))
        gap = F.col("raw_dnx") - F.col("prediction")
        one = scored.agg(F.lit(held).alias("held_out"), F.count(F.lit(1)).alias("n"), (1 - F.avg(gap * gap) / F.when(F.var_pop("raw_dnx") > 1e-12, F.var_pop("raw_dnx"))).alias("r2"))
        out = one if out is None else out.unionByName(one)
    return out


RULES = [("n_cohorts", ">=", 8, True), ("share_unmapped", "<=", 0.05, True), ("n_markers", ">=", 4, True), ("mean_conf", ">=", 0.99, False)]
_CHECKS = " UNION ALL ".join(
    f"SELECT '{n}' AS \"check\", {n}::DOUBLE AS value, {t}::DOUBLE AS threshold, {str(r).lower()} AS required, CASE WHEN {n} IS NULL THEN 'UNDECIDED' WHEN {n} {o} {t} THEN 'PASS' ELSE 'FAIL' END AS outcome FROM o" for n, o, t, r in RULES
)


@register(f"WITH {M}, o AS (SELECT count(DISTINCT cohort) AS n_cohorts, round(count(*) FILTER (WHERE x.cluster IS NULL) / count(*)::DOUBLE, 6) AS share_unmapped, 4 AS n_markers, round(avg(conf), 6) AS mean_conf FROM m LEFT JOIN label_map x USING (cohort, label)) {_CHECKS}")
def gate_report(spark: SparkSession, d: str) -> DataFrame:
    """O1, O2: declared checks on observed quantities."""
    c = standard_cells(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("s"), F.count("conf").alias("k"))
    j = c.join(table(spark, d, "label_map").select("cohort", "label", "cluster"), ["cohort", "label"], "left")
    observed = j.agg(
        F.count_distinct("cohort").alias("n_cohorts"), fixed(F.sum(F.when(F.col("cluster").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("share_unmapped"),
        F.lit(len(MARKERS) - 1).alias("n_markers"), fixed(F.sum("s") / F.sum("k"), 6).alias("mean_conf"),
    )
    return gates.evaluate(observed, RULES)


@register("SELECT cohort, bool_or(cohort_role = 'holdout') AS held_out, count(*) FILTER (WHERE image_id IS NOT NULL) > 0 AS has_rows FROM cohorts LEFT JOIN (SELECT DISTINCT upper(trim(cohort)) AS cohort, image_id FROM cells) USING (cohort) GROUP BY 1")
def leak_guard(spark: SparkSession, d: str) -> DataFrame:
    """Which cohorts may train, and which have rows at all."""
    seen = table(spark, d, "cells").where("image_id is not null and cohort is not null").select(F.upper(F.trim("cohort")).alias("cohort")).distinct().withColumn("has", F.lit(True))
    c = table(spark, d, "cohorts").join(seen, "cohort", "left")
    return c.select("cohort", (F.col("cohort_role") == "holdout").alias("held_out"), F.coalesce("has", F.lit(False)).alias("has_rows"))


@register(f"""WITH {M}, a AS (SELECT DISTINCT load_id, cell_id, label FROM m), b AS (SELECT load_id, cell_id, lower(trim(native_label)) AS label FROM cells WHERE cohort IS NOT NULL AND image_id IS NOT NULL AND native_label IS NOT NULL),
c AS (SELECT load_id, cell_id, label, count(*) AS n FROM a GROUP BY ALL), e AS (SELECT load_id, cell_id, label, count(*) AS n FROM b GROUP BY ALL),
f AS (SELECT coalesce(c.load_id, e.load_id) AS load_id, coalesce(c.cell_id, e.cell_id) AS cell_id, coalesce(c.label, e.label) AS label, coalesce(c.n, 0) - coalesce(e.n, 0) AS more
FROM c FULL JOIN e ON c.load_id IS NOT DISTINCT FROM e.load_id AND c.cell_id IS NOT DISTINCT FROM e.cell_id AND c.label = e.label)
SELECT only_in, count(*) AS n_rows, sum(abs(more))::BIGINT AS times FROM (SELECT more, CASE WHEN more > 0 THEN 'first' ELSE 'second' END AS only_in FROM f WHERE more <> 0) GROUP BY 1""")
def identity_guard(spark: SparkSession, d: str) -> DataFrame:
    """What two loaders don't share, over every load: the standard cells without repeats, and rows read as they lie."""
    first = standard_cells(spark, d).select("load_id", "cell_id", "label").distinct()
    rows = table(spark, d, "cells").where("cohort is not null and image_id is not null and native_label is not null")
    second = rows.select("load_id", "cell_id", F.lower(F.trim("native_label")).alias("label"))
    return gates.differences(first, second).groupBy("only_in").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("times").alias("times"))


@register("SELECT load_id, cell_id, count(*) - 1 AS times, 'first' AS only_in FROM cells GROUP BY 1, 2 HAVING count(*) > 1")
def identity_guard_all(spark: SparkSession, d: str) -> DataFrame:
    """Rows that reading without repeats loses, over every load."""
    a = table(spark, d, "cells").select("load_id", "cell_id")
    return gates.differences(a, a.distinct())


@register("SELECT cluster, bool_or(unreliable) AS flagged, string_agg(DISTINCT unreliable_reason, ', ' ORDER BY unreliable_reason) AS reasons FROM label_map GROUP BY 1")
def waiver_flags(spark: SparkSession, d: str) -> DataFrame:
    """Failing cases flag their clusters downstream."""
    reasons = F.array_join(F.array_sort(F.collect_set("unreliable_reason")), ", ")
    return table(spark, d, "label_map").groupBy("cluster").agg(F.bool_or("unreliable").alias("flagged"), F.when(F.count("unreliable_reason") > 0, reasons).alias("reasons"))
