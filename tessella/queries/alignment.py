"""Label alignment (L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed
from tessella.operators import alignment as al
from tessella.operators import linkage
from tessella.plans.materialize import compute_or_load, cut
from tessella.sources.standard import MARKERS, standard_cells, stored_counts
from tessella.sources.tables import table

from .registry import L, U, Registry

REGISTRY = register = Registry()
K = 3

_SIG = U + """, sig AS (SELECT cohort, label, marker, count(*) AS n, avg(u) AS mean_u, quantile_cont(u, .1) AS q10, quantile_cont(u, .5) AS q50, quantile_cont(u, .9) AS q90
FROM u GROUP BY 1, 2, 3 HAVING count(*) >= 100)"""
_RES = _SIG + """, mid AS (SELECT cohort, marker, median(mean_u) AS mid, max(mean_u) - min(mean_u) AS weight FROM sig GROUP BY 1, 2),
res AS (SELECT cohort, label, marker, n, weight, (mean_u - mid) / greatest(weight, .05) AS p, (q10 - mid) / greatest(weight, .05) AS lo, (q90 - mid) / greatest(weight, .05) AS hi FROM sig JOIN mid USING (cohort, marker))"""
_CMP = _RES + """, pr AS (SELECT a.cohort AS cohort_a, a.label AS label_a, b.cohort AS cohort_b, b.label AS label_b, marker, least(a.weight, b.weight) AS w, a.p - b.p AS gap,
least(1, greatest(0, CASE WHEN a.hi - a.lo > 1e-6 THEN greatest(0, least(a.hi, b.hi) - greatest(a.lo, b.lo)) / (a.hi - a.lo) ELSE (a.lo >= b.lo - 1e-6 AND a.lo <= b.hi + 1e-6)::INT END)) AS o
FROM res a JOIN res b USING (marker) WHERE (a.cohort, a.label) <> (b.cohort, b.label) AND least(a.weight, b.weight) >= .1),
ag AS (SELECT cohort_a, label_a, cohort_b, label_b, count(*) AS evidence, sqrt(sum(w * gap * gap) / sum(w)) AS d, exp(sum(w * ln(greatest(o, .05))) / sum(w)) AS containment FROM pr GROUP BY 1, 2, 3, 4),
blk AS (SELECT cohort_a, cohort_b, median(d) AS mid FROM ag WHERE d > 0 GROUP BY 1, 2),
cmp AS (SELECT ag.*, exp(-d / coalesce(mid, 1)) AS similarity FROM ag LEFT JOIN blk USING (cohort_a, cohort_b))"""
_DST = _CMP + """, dst AS (SELECT a.cohort_a, a.label_a, a.cohort_b, a.label_b, a.evidence, CASE WHEN a.evidence < 3 THEN 5.0 ELSE (-ln(least(1, greatest(1e-6, a.similarity))) - ln(least(1, greatest(1e-6, b.similarity)))) / 2 END AS distance
FROM cmp a JOIN cmp b ON a.cohort_a = b.cohort_b AND a.label_a = b.label_b AND a.cohort_b = b.cohort_a AND a.label_b = b.label_a WHERE (a.cohort_a, a.label_a) < (a.cohort_b, a.label_b))"""


def _sig(spark: SparkSession, d: str) -> DataFrame:
    return compute_or_load(spark, "signatures", [f"{d}/cells.parquet"], lambda: al.signatures(stored_counts(spark, d, "cohort", "label")))


def _scaled(spark: SparkSession, d: str) -> DataFrame:
    """Rescaled signatures, written once: they are small, and every comparison reads them twice."""
    return cut(al.rescale(_sig(spark, d)), "signatures")


def _compared(spark: SparkSession, d: str) -> DataFrame:
    return al.compare(_scaled(spark, d))


def _distances(spark: SparkSession, d: str) -> DataFrame:
    return cut(al.distances(cut(_compared(spark, d), "compared"), K), "distances")


def _rounded(df: DataFrame, *columns: str, digits: int = 5) -> DataFrame:
    return df.withColumns({c: fixed(c, digits) for c in columns})


@register(f"WITH {_SIG} SELECT cohort, label, marker, n, round(mean_u, 6) AS mean_u, round(q10, 6) AS q10, round(q50, 6) AS q50, round(q90, 6) AS q90 FROM sig")
def signatures(spark: SparkSession, d: str) -> DataFrame:
    """L1: the signature of every (cohort, label, marker) with at least 100 rows."""
    return _rounded(_sig(spark, d), "mean_u", "q10", "q50", "q90", digits=6)


@register(f"WITH {_RES} SELECT cohort, label, marker, n, round(weight, 5) AS weight, round(p, 5) AS p, round(lo, 5) AS lo, round(hi, 5) AS hi FROM res")
def rescale(spark: SparkSession, d: str) -> DataFrame:
    """L2, E5: signatures on the scale of their cohort."""
    return _rounded(al.rescale(_sig(spark, d)), "weight", "p", "lo", "hi")


@register(f"WITH {_CMP} SELECT cohort_a, label_a, cohort_b, label_b, evidence FROM cmp")
def evidence(spark: SparkSession, d: str) -> DataFrame:
    """L3: informative markers that two labels share."""
    return _compared(spark, d).select(*al.PAIR, "evidence")


@register(f"WITH {_CMP} SELECT cohort_a, label_a, cohort_b, label_b, round(similarity, 5) AS similarity FROM cmp")
def similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity by weighted distance, each block of two cohorts on its own median."""
    return _rounded(_compared(spark, d).select(*al.PAIR, "similarity"), "similarity")


@register(f"WITH {_CMP} SELECT cohort_a, label_a, cohort_b, label_b, round(containment, 5) AS containment FROM cmp")
def containment(spark: SparkSession, d: str) -> DataFrame:
    """How far one label's spread lies inside another's."""
    return _rounded(_compared(spark, d).select(*al.PAIR, "containment"), "containment")


_NAMES = sorted(MARKERS)
_COEX = L + ", cx AS (" + " UNION ALL ".join(
    f"SELECT cohort, label, '{a}|{b}' AS pair, covar_pop({MARKERS[a]}, {MARKERS[b]}) / (stddev_pop({MARKERS[a]}) * stddev_pop({MARKERS[b]})) AS r FROM m WHERE {MARKERS[a]} IS NOT NULL AND {MARKERS[b]} IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100 AND stddev_pop({MARKERS[a]}) > 1e-6 AND stddev_pop({MARKERS[b]}) > 1e-6"
    for i, a in enumerate(_NAMES) for b in _NAMES[i + 1 :]) + ")"


@register(f"WITH {_COEX} SELECT a.cohort AS cohort_a, a.label AS label_a, b.cohort AS cohort_b, b.label AS label_b, count(*) AS n, round(covar_pop(a.r, b.r) / (stddev_pop(a.r) * stddev_pop(b.r)), 4) AS agreement FROM cx a JOIN cx b USING (pair) WHERE a.cohort < b.cohort GROUP BY 1, 2, 3, 4 HAVING count(*) >= 3 AND stddev_pop(a.r) > 1e-6 AND stddev_pop(b.r) > 1e-6")
def coexpr_agree(spark: SparkSession, d: str) -> DataFrame:
    """Do two labels agree which markers go together?"""
    return _rounded(al.coexpression_agreement(al.coexpression(standard_cells(spark, d), MARKERS)), "agreement", digits=4)


@register(f"WITH {_DST} SELECT cohort_a, label_a, cohort_b, label_b, evidence, round(distance, 5) AS distance FROM dst")
def label_distance(spark: SparkSession, d: str) -> DataFrame:
    """The distance that clustering works on."""
    return _rounded(al.distances(cut(_compared(spark, d), "compared"), K), "distance")


@register(f"""WITH {_CMP}, bl AS (SELECT x.cluster AS a, y.cluster AS b, avg(CASE WHEN evidence >= 3 THEN containment END) AS c, count(*) FILTER (WHERE evidence >= 3) AS pairs, avg(similarity) AS s
FROM cmp JOIN label_map x ON x.cohort = cohort_a AND x.label = label_a JOIN label_map y ON y.cohort = cohort_b AND y.label = label_b WHERE x.cluster <> y.cluster GROUP BY 1, 2)
SELECT p.a, p.b, round(p.c, 5) AS c, p.pairs FROM bl p LEFT JOIN bl q ON q.a = p.b AND q.b = p.a WHERE p.c >= .3 AND -ln(greatest(p.s, 1e-9)) <= 1.5 AND (q.c IS NULL OR p.c - q.c >= .02)""")
def nesting_edges(spark: SparkSession, d: str) -> DataFrame:
    """Clusters inside other clusters, with bounds that fit five markers."""
    return _rounded(al.nesting(_compared(spark, d), table(spark, d, "label_map"), K, contain=0.3, margin=0.02), "c")


@register(f"""WITH {_RES}, cl AS (SELECT x.cluster, marker, avg(p) AS c, count(*) AS k FROM res JOIN label_map x USING (cohort, label) GROUP BY 1, 2), sz AS (SELECT cluster, count(*) AS size FROM label_map GROUP BY 1),
nc AS (SELECT marker, count(DISTINCT cohort) AS n FROM res GROUP BY 1), z AS (SELECT cluster, marker, round((c - avg(c) OVER w) / nullif(stddev_pop(c) OVER w, 0), 6) AS z, k * 2 >= size AND n >= 3 AS usable FROM cl JOIN sz USING (cluster) JOIN nc USING (marker) WINDOW w AS (PARTITION BY marker)),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY z DESC, marker) AS hi, row_number() OVER (PARTITION BY cluster ORDER BY z, marker) AS lo FROM z WHERE usable AND z IS NOT NULL)
SELECT cluster, coalesce(string_agg(CASE WHEN hi <= 3 AND z > .8 THEN marker || '+' WHEN lo = 1 AND z < -1.2 THEN marker || '-' END, ' ' ORDER BY z DESC, marker), 'nothing stands out') AS name FROM r GROUP BY 1""")
def cluster_naming(spark: SparkSession, d: str) -> DataFrame:
    """Names from markers that stand out, measured by half the labels and three cohorts."""
    return al.name_clusters(_scaled(spark, d), table(spark, d, "label_map"))


@register("""WITH c AS (SELECT label, count(*) AS k, count(DISTINCT cluster) AS n, bool_or(unreliable) AS waived FROM label_map GROUP BY 1)
SELECT label, CASE WHEN k < 2 THEN 'n/a' WHEN n = 1 THEN 'PASS' WHEN waived THEN 'WAIVED' ELSE 'FAIL' END AS outcome FROM c""")
def hard_cases(spark: SparkSession, d: str) -> DataFrame:
    """A label of several cohorts should be in one cluster; flagged ones are waived."""
    c = table(spark, d, "label_map").groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("cluster").alias("n"), F.bool_or("unreliable").alias("waived"))
    return c.select("label", F.when(F.col("k") < 2, "n/a").when(F.col("n") == 1, "PASS").when(F.col("waived"), "WAIVED").otherwise("FAIL").alias("outcome"))


@register(f"""WITH {_DST}, side AS (SELECT label_b AS label, cohort_a AS c, label_a AS l, distance FROM dst WHERE cohort_b = 'UMBRA' AND cohort_a <> 'UMBRA' UNION ALL SELECT label_a, cohort_b, label_b, distance FROM dst WHERE cohort_a = 'UMBRA' AND cohort_b <> 'UMBRA'),
me AS (SELECT s.label, x.cluster, avg(distance) AS distance FROM side s JOIN label_map x ON x.cohort = c AND x.label = l GROUP BY 1, 2)
SELECT label, CASE WHEN distance <= 1.2 AND distance < 5 THEN cluster ELSE -1 END AS cluster, round(distance, 5) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), cluster) AS rn FROM me) WHERE rn = 1""")
def placement(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a held-out cohort placed among frozen clusters, or NOVEL."""
    return _rounded(al.place(_distances(spark, d), table(spark, d, "label_map"), "UMBRA", 1.2), "distance")


@register(f"WITH {_CMP}, k AS (SELECT unnest([1, 2, 3, 4, 5]) AS k) SELECT k::INT AS k, cohort_a, cohort_b, count(*) FILTER (WHERE evidence >= k) AS n_pairs, median(evidence)::DOUBLE AS median_evidence FROM cmp, k WHERE cohort_a < cohort_b GROUP BY 1, 2, 3")
def evidence_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that each evidence floor leaves."""
    c = _compared(spark, d).where("cohort_a < cohort_b").withColumn("k", F.explode(F.array(*map(F.lit, range(1, 6)))))
    return c.groupBy("k", "cohort_a", "cohort_b").agg(F.count_if(F.col("evidence") >= F.col("k")).alias("n_pairs"), F.percentile("evidence", F.lit(0.5)).alias("median_evidence"))


@register(f"WITH {_RES}, s AS (SELECT label, marker, count(*) AS k, min(weight) AS w FROM res GROUP BY 1, 2), n AS (SELECT label, count(DISTINCT cohort) AS n FROM res GROUP BY 1) SELECT label, marker FROM s JOIN n USING (label) WHERE k = n AND w >= .1")
def common_markers(spark: SparkSession, d: str) -> DataFrame:
    """Informative markers that all cohorts of a label have."""
    scaled = _scaled(spark, d)
    n = scaled.groupBy("label").agg(F.count_distinct("cohort").alias("n_all"))
    s = scaled.groupBy("label", "marker").agg(F.count(F.lit(1)).alias("k"), F.min("weight").alias("w"))
    return s.join(n, "label").where("k = n_all and w >= 0.1").select("label", "marker")


@register("SELECT cluster, count(*) AS n_labels, count(DISTINCT cohort) AS n_cohorts, string_agg(cohort || '|' || label, '; ' ORDER BY cohort || '|' || label) AS members FROM label_map GROUP BY 1")
def cluster_table(spark: SparkSession, d: str) -> DataFrame:
    """What each cluster is made of."""
    member = F.concat_ws("|", "cohort", "label")
    return table(spark, d, "label_map").groupBy("cluster").agg(F.count(F.lit(1)).alias("n_labels"), F.count_distinct("cohort").alias("n_cohorts"), F.array_join(F.array_sort(F.collect_list(member)), "; ").alias("members"))


@register(f"WITH {L}, s AS (SELECT x.cluster_name AS type, marker, count(DISTINCT cohort) AS support FROM l JOIN label_map x USING (cohort, label) GROUP BY 1, 2) SELECT marker, count(*) FILTER (WHERE support >= 2) AS specificity, sum(support)::BIGINT AS support FROM s GROUP BY 1")
def specificity(spark: SparkSession, d: str) -> DataFrame:
    """How many types a marker is seen in."""
    seen = stored_counts(spark, d, "cohort", "label").select("cohort", "label", "marker").distinct()
    s = seen.join(table(spark, d, "label_map").select("cohort", "label", F.col("cluster_name").alias("type")), ["cohort", "label"]).groupBy("type", "marker").agg(F.count_distinct("cohort").alias("support"))
    return s.groupBy("marker").agg(F.count_if(F.col("support") >= 2).alias("specificity"), F.sum("support").alias("support"))


@register("""WITH n AS (SELECT DISTINCT upper(core) AS core FROM marker_registry WHERE cohort = 'UMBRA' AND core <> ''), o AS (SELECT DISTINCT upper(core) AS core FROM marker_registry WHERE cohort <> 'UMBRA' AND core <> '')
SELECT core, core IN (SELECT core FROM o) AS known FROM n""")
def new_cohort_markers(spark: SparkSession, d: str) -> DataFrame:
    """Markers of a new cohort that the others know, and those they don't."""
    reg = table(spark, d, "marker_registry").where("core <> ''").select("cohort", F.upper("core").alias("core"))
    old = reg.where("cohort <> 'UMBRA'").select("core").distinct().withColumn("seen", F.lit(True))
    return reg.where("cohort = 'UMBRA'").select("core").distinct().join(old, "core", "left").select("core", F.coalesce("seen", F.lit(False)).alias("known"))


@register(f"WITH {_CMP} SELECT cohort_a AS cohort, count(*) AS n, 0.0::DOUBLE AS max_change FROM cmp WHERE cohort_a <> 'UMBRA' AND cohort_b <> 'UMBRA' GROUP BY 1")
def noninterference(spark: SparkSession, d: str) -> DataFrame:
    """The similarity of all other labels, worked out from the cells with and without a late cohort; it must not change."""
    counts = stored_counts(spark, d, "cohort", "label").where("cohort <> 'UMBRA'")
    without = al.compare(cut(al.rescale(al.signatures(counts)), "without")).select(*al.PAIR, F.col("similarity").alias("before"))
    both = _compared(spark, d).where("cohort_a <> 'UMBRA' and cohort_b <> 'UMBRA'").select(*al.PAIR, "similarity").join(without, al.PAIR, "full")
    change = F.coalesce(F.abs(F.col("similarity") - F.col("before")), F.lit(1.0))
    return both.groupBy(F.col("cohort_a").alias("cohort")).agg(F.count(F.lit(1)).alias("n"), fixed(F.max(change), 9).alias("max_change"))


CUTS = [round(0.30 + 0.1 * i, 4) for i in range(13)]


@register()
def upgma_cut(spark: SparkSession, d: str) -> DataFrame:
    """Labels clustered by average linkage at one cut (no SQL)."""
    return linkage.clusters(_distances(spark, d), 0.8)


@register()
def cut_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Clusters, cohort agreement and stability over the cuts (no SQL)."""
    return linkage.sweep(_distances(spark, d), CUTS)


@register()
def refine_split(spark: SparkSession, d: str) -> DataFrame:
    """Binary splits of the clusters and why they are kept or not (no SQL)."""
    return linkage.refine(_distances(spark, d), 0.8)


@register()
def matched_cut(spark: SparkSession, d: str) -> DataFrame:
    """The cut with as many clusters as the map has (no SQL)."""
    wanted = table(spark, d, "label_map").agg(F.count_distinct("cluster").alias("k")).first()["k"]
    return linkage.matched_cut(_distances(spark, d), CUTS, wanted)


@register()
def holdout_control(spark: SparkSession, d: str) -> DataFrame:
    """Clusters found without the held-out cohort, next to those found with it (no SQL)."""
    dist = _distances(spark, d)
    without = linkage.clusters(dist.where("cohort_a <> 'UMBRA' and cohort_b <> 'UMBRA'"), 0.8).withColumnRenamed("cluster", "control")
    return linkage.clusters(dist, 0.8).join(without, ["cohort", "label"]).groupBy("cluster", "control").agg(F.count(F.lit(1)).alias("n"))
