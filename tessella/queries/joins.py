"""Joins (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed
from tessella.operators import matching, schema
from tessella.sources.standard import long_values, standard_cells, stored_counts
from tessella.sources.tables import table

from .registry import L, M, Registry

REGISTRY = register = Registry()


@register(f"WITH {M} SELECT m.cell_id, m.cohort, c.tech, c.tissue FROM m LEFT JOIN cohorts c USING (cohort)")
def left_join_checked(spark: SparkSession, d: str) -> DataFrame:
    """A left join that fails if the right key isn't unique, so rows never multiply."""
    right = schema.assert_unique(table(spark, d, "cohorts").select("cohort", "tech", "tissue"), ["cohort"])
    return standard_cells(spark, d).select("cell_id", "cohort").join(right, "cohort", "left")


@register(f"WITH {M}, k AS (SELECT cohort, label, count(*) AS n FROM m GROUP BY 1, 2) SELECT k.cohort, k.label, n, x.cluster FROM k LEFT JOIN label_map x ON x.cohort = k.cohort AND x.label = k.label")
def composite_key_join(spark: SparkSession, d: str) -> DataFrame:
    """A left join on two keys that are named differently on the right."""
    counts = standard_cells(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("n"))
    mapped = table(spark, d, "label_map").select(F.col("cohort").alias("in_cohort"), F.col("label").alias("in_label"), "cluster")
    return counts.join(mapped, (F.col("cohort") == F.col("in_cohort")) & (F.col("label") == F.col("in_label")), "left").select("cohort", "label", "n", "cluster")


@register("""SELECT l.load_id, l.n_rows_declared, c.n AS n_rows, l.n_rows_declared IS NOT NULL AND l.n_rows_declared = c.n AS agrees
FROM loads l LEFT JOIN (SELECT load_id, count(*) AS n FROM cells GROUP BY 1) c USING (load_id)""")
def one_to_one_check(spark: SparkSession, d: str) -> DataFrame:
    """Both keys unique, and two sources of the same number compared."""
    loads = schema.assert_unique(table(spark, d, "loads"), ["load_id"]).select("load_id", "n_rows_declared")
    counted = table(spark, d, "cells").groupBy("load_id").agg(F.count(F.lit(1)).alias("n_rows"))
    agrees = F.col("n_rows_declared").isNotNull() & (F.col("n_rows_declared") == F.col("n_rows"))
    return loads.join(counted, "load_id", "left").withColumn("agrees", agrees)


@register("""WITH s AS (SELECT load_id, count(*) AS n, round(avg(label_confidence::DOUBLE), 6) AS conf FROM cells WHERE label_confidence::VARCHAR <> 'nan' GROUP BY 1)
SELECT l.load_id, a.n AS n_new, b.n AS n_old, round(a.conf - b.conf, 6) AS conf_change FROM loads l JOIN s a USING (load_id) JOIN s b ON b.load_id = l.baseline_load_id""")
def version_compare(spark: SparkSession, d: str) -> DataFrame:
    """C4: two versions of one summary side by side."""
    rows = table(spark, d, "cells").where("label_confidence is not null and not isnan(label_confidence)")
    s = rows.groupBy("load_id").agg(F.count(F.lit(1)).alias("n"), fixed(F.avg(F.col("label_confidence").cast("double")), 6).alias("conf"))
    old = s.select(F.col("load_id").alias("baseline_load_id"), F.col("n").alias("n_old"), F.col("conf").alias("old"))
    pairs = table(spark, d, "loads").select("load_id", "baseline_load_id")
    return pairs.join(s, "load_id").join(old, "baseline_load_id").select("load_id", F.col("n").alias("n_new"), "n_old", fixed(F.col("conf") - F.col("old"), 6).alias("conf_change"))


@register(f"WITH {M} SELECT coalesce(x.cluster, -1) AS cluster, count(*) AS n FROM m LEFT JOIN label_map x ON x.cohort = m.cohort AND x.label = m.label GROUP BY 1")
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary lookup with -1 for what isn't in it; rows are counted before they are joined."""
    counts = standard_cells(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("n"))
    found = counts.join(table(spark, d, "label_map").select("cohort", "label", "cluster"), ["cohort", "label"], "left")
    return found.groupBy(F.coalesce("cluster", F.lit(-1)).alias("cluster")).agg(F.sum("n").alias("n"))


@register(f"WITH {M} SELECT cohort, count(*) AS n FROM m WHERE image_id IN (SELECT image_id FROM m GROUP BY 1 HAVING count(*) >= 200) GROUP BY 1")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the slides that have enough of them."""
    cells = standard_cells(spark, d).select("cohort", "image_id")
    large = cells.groupBy("image_id").count().where("count >= 200").select("image_id")
    return cells.join(large, "image_id", "left_semi").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@register("SELECT g.registry_id, g.resolved_id, r.symbol, r.kind FROM marker_registry g JOIN marker_reference r ON r.canon_id = g.resolved_id")
def ordered_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Ids looked up in a table where each must be unique."""
    entries = schema.assert_unique(table(spark, d, "marker_reference").select(F.col("canon_id").alias("resolved_id"), "symbol", "kind"), ["resolved_id"])
    return table(spark, d, "marker_registry").select("registry_id", "resolved_id").join(entries, "resolved_id")


@register(f"WITH {M} SELECT DISTINCT m.cohort, m.label FROM m WHERE NOT EXISTS (SELECT 1 FROM label_map x WHERE x.cohort = m.cohort AND x.label = m.label)")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """Labels that the map doesn't know."""
    return standard_cells(spark, d).select("cohort", "label").distinct().join(table(spark, d, "label_map"), ["cohort", "label"], "left_anti")


@register("""SELECT a.label AS label_a, b.label AS label_b, count(*) AS n_cohorts, count(*) FILTER (WHERE a.cluster = b.cluster) AS n_together
FROM label_map a JOIN label_map b ON a.cohort = b.cohort AND a.label < b.label GROUP BY 1, 2""")
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs within a cohort, by an equi-join rather than all pairs."""
    x = table(spark, d, "label_map").select("cohort", "label", "cluster")
    y = x.select("cohort", F.col("label").alias("label_b"), F.col("cluster").alias("cluster_b"))
    return x.join(y, "cohort").where("label < label_b").groupBy(F.col("label").alias("label_a"), "label_b").agg(
        F.count(F.lit(1)).alias("n_cohorts"), F.count_if(F.col("cluster") == F.col("cluster_b")).alias("n_together")
    )


MEANS = L + """, g AS (SELECT cohort, label, marker, avg(v) AS mean, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 100),
z AS (SELECT cohort, label, marker, (mean - avg(mean) OVER w) / nullif(stddev_pop(mean) OVER w, 0) AS z FROM g WINDOW w AS (PARTITION BY cohort, marker))"""


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    counts = stored_counts(spark, d, "cohort", "label")
    return matching.standard_profiles(counts, ["cohort"], "label", least=100)


@register(f"WITH {MEANS} SELECT a.cohort AS cohort_a, a.label AS label_a, b.cohort AS cohort_b, b.label AS label_b, count(*) AS n_shared, round(sqrt(avg((a.z - b.z) * (a.z - b.z))), 6) AS distance "
          "FROM z a JOIN z b USING (marker) WHERE a.cohort < b.cohort AND a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY ALL HAVING count(*) >= 3")  # fmt: skip
def marker_pairs(spark: SparkSession, d: str) -> DataFrame:
    """C11: labels of different cohorts compared marker by marker, by an equi-join on the marker."""
    return matching.profile_distances(_profiles(spark, d), least_shared=3)


@register(f"WITH {MEANS}, p AS (SELECT a.cohort, a.label, b.cohort AS other, b.label AS nearest, sqrt(avg((a.z - b.z) * (a.z - b.z))) AS distance FROM z a JOIN z b USING (marker) "
          "WHERE a.cohort <> b.cohort AND a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY ALL HAVING count(*) >= 3), "
          "r AS (SELECT *, row_number() OVER (PARTITION BY cohort, label, other ORDER BY round(distance, 9), nearest) AS rn FROM p) "
          "SELECT cohort, label, other, CASE WHEN distance <= 1.0 THEN nearest ELSE 'NOVEL' END AS nearest, round(distance, 6) AS distance FROM r WHERE rn = 1")  # fmt: skip
def nearest_label(spark: SparkSession, d: str) -> DataFrame:
    """The nearest label in each other cohort, or NOVEL if it lies too far."""
    return matching.nearest(_profiles(spark, d), least_shared=3, most=1.0)


@register(f"WITH {L} SELECT marker, count(DISTINCT cohort) AS n_cohorts FROM l GROUP BY 1 HAVING count(DISTINCT cohort) = (SELECT count(DISTINCT cohort) FROM l)")
def core_panel(spark: SparkSession, d: str) -> DataFrame:
    """Markers that every cohort measured."""
    seen = long_values(standard_cells(spark, d), "cohort").distinct().select("cohort", "marker").distinct()
    n = seen.agg(F.count_distinct("cohort").alias("n_all"))
    return seen.groupBy("marker").agg(F.count(F.lit(1)).alias("n_cohorts")).join(n, F.col("n_cohorts") == F.col("n_all")).select("marker", "n_cohorts")
