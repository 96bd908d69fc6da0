"""Registered queries of the quality operators, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import quality
from tessella.sources.tables import table


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "cells"), table(spark, d, "loads"), table(spark, d, "cohorts")


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every column of cells, per load."""
    return quality.profile_columns(table(spark, d, "cells"))


def p3_drift(spark: SparkSession, d: str) -> DataFrame:
    """How well each load can be told from its baseline, by which column, and how far their distributions differ."""
    return quality.distribution_changes(*_tables(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Loads with broken values or changed distributions."""
    return quality.load_issues(*_tables(spark, d))


QUERIES = {f.__name__: f for f in (p3_profile, p3_drift, p3_found)}

_NUMBERS = ("cell_id", "x_px", "y_px", "area_px2", "label_confidence", "raw_dnx", "raw_velk2", "raw_orsa1", "raw_tamq4")
_FLOATS = set(_NUMBERS) - {"cell_id"}
_TEXTS = ("cohort", "image_id", "patient_id", "native_label")


def _profile_of(c: str) -> str:
    value = f"CASE WHEN {c}::VARCHAR <> 'nan' THEN {c} END" if c in _FLOATS else c
    low, high, first, last = "NULL::DOUBLE", "NULL::DOUBLE", "NULL::VARCHAR", "NULL::VARCHAR"
    if c in _NUMBERS:
        low, high = f"min(({value})::DOUBLE)", f"max(({value})::DOUBLE)"
    elif c in _TEXTS:
        first, last = f"min({c})", f"max({c})"
    else:
        low, high = f"min(epoch_us({c}) / 1e6)", f"max(epoch_us({c}) / 1e6)"
    return (
        f"SELECT load_id, '{c}' AS column_name, count(*)::BIGINT AS n_rows, (count(*) - count({value}))::BIGINT AS n_null, "
        f"(count(*) - count({value})) / count(*)::DOUBLE AS null_rate, count(DISTINCT {value})::BIGINT AS n_distinct, "
        f"{low} AS min_value, {high} AS max_value, {first} AS min_text, {last} AS max_text FROM cells GROUP BY load_id"
    )


_NO_PATIENT = """(patient_id IS NULL OR lower(trim(patient_id)) IN ('', 'nan', 'none', 'null', 'na')
    OR regexp_matches(lower(trim(patient_id)), '[|](nan|unknown|<na>|-1)$'))"""

SQL = {
    "p3_profile": " UNION ALL ".join(map(_profile_of, (*_NUMBERS, *_TEXTS, "loaded_at"))),
    "p3_found": f"""
WITH c AS (SELECT load_id, CASE WHEN area_px2::VARCHAR <> 'nan' THEN area_px2 END AS area_px2,
    CASE WHEN label_confidence::VARCHAR <> 'nan' THEN label_confidence::DOUBLE END AS label_confidence,
    CASE WHEN NOT {_NO_PATIENT} THEN patient_id END AS patient_id FROM cells WHERE load_id IS NOT NULL),
pairs AS (SELECT load_id, baseline_load_id AS base FROM loads WHERE baseline_load_id IS NOT NULL),
rates AS (SELECT load_id, 'area_px2' AS column_name, 1 - count(area_px2) / count(*)::DOUBLE AS rate FROM c GROUP BY 1
    UNION ALL SELECT load_id, 'label_confidence', 1 - count(label_confidence) / count(*)::DOUBLE FROM c GROUP BY 1
    UNION ALL SELECT load_id, 'patient_id', 1 - count(patient_id) / count(*)::DOUBLE FROM c GROUP BY 1),
vals AS (SELECT load_id, 'area_px2' AS column_name, area_px2 AS v FROM c WHERE area_px2::VARCHAR NOT IN ('inf', '-inf')
    UNION ALL SELECT load_id, 'label_confidence', label_confidence FROM c WHERE label_confidence::VARCHAR NOT IN ('inf', '-inf')),
sided AS (SELECT p.load_id, column_name, v, 1 AS ours FROM pairs p JOIN vals USING (load_id)
    UNION ALL SELECT p.load_id, column_name, v, 0 FROM pairs p JOIN vals x ON x.load_id = p.base),
points AS (SELECT load_id, column_name, v, sum(ours) AS o, sum(1 - ours) AS t FROM sided GROUP BY ALL),
steps AS (SELECT load_id, column_name, sum(o) OVER (w ORDER BY v) / nullif(sum(o) OVER w, 0)::DOUBLE
    - sum(t) OVER (w ORDER BY v) / nullif(sum(t) OVER w, 0)::DOUBLE AS d FROM points WINDOW w AS (PARTITION BY load_id, column_name))
SELECT DISTINCT load_id, 'area_px2' AS column_name, 'range' AS issue FROM c WHERE NOT (area_px2 > 0 AND area_px2 <= 5000)
UNION ALL SELECT DISTINCT load_id, 'label_confidence', 'range' FROM c WHERE NOT (label_confidence >= 0 AND label_confidence <= 1)
UNION ALL SELECT DISTINCT load_id, 'patient_id', 'pattern' FROM c LEFT JOIN cohorts h ON h.cohort = split_part(patient_id, '|', 1)
    WHERE patient_id IS NOT NULL AND NOT coalesce(regexp_full_match(patient_id, patient_pattern), false)
UNION ALL SELECT r.load_id, r.column_name, 'null_rate' FROM pairs p JOIN rates r USING (load_id)
    JOIN rates b ON b.load_id = p.base AND b.column_name = r.column_name WHERE abs(r.rate - b.rate) > 0.05
UNION ALL SELECT DISTINCT load_id, column_name, 'drift' FROM steps WHERE abs(d) > 0.2""",
}
