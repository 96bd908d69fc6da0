"""Sources, projections, filters and schema rules (A, B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.cells import null_number
from tessella.functions.numbers import fixed
from tessella.operators import schema
from tessella.plans.materialize import cut
from tessella.sources import files
from tessella.sources.standard import MARKERS, null_like, standard_cells, standard_label
from tessella.sources.tables import table

from .registry import M, Registry

REGISTRY = register = Registry()


@register("SELECT cell_id, image_id, load_id, area_px2 FROM cells WHERE area_px2 > 250")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    """A pruned scan with its filter pushed down, of every load."""
    return schema.require(table(spark, d, "cells"), ["cell_id", "image_id", "load_id", "area_px2"]).where("area_px2 > 250").select("cell_id", "image_id", "load_id", "area_px2")


@register("SELECT cell_id, image_id, area_px2 FROM cells WHERE area_px2 > 250")
def scan_project_all(spark: SparkSession, d: str) -> DataFrame:
    """The same without the load."""
    return schema.require(table(spark, d, "cells"), ["cell_id", "image_id", "area_px2"]).where("area_px2 > 250").select("cell_id", "image_id", "area_px2")


@register("SELECT raw_column, coalesce(note, '') AS note, count(*) AS n FROM marker_registry WHERE raw_column IS NOT NULL AND raw_column <> '' GROUP BY ALL")
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Text columns written as CSV and read back, 'NA' kept as a name."""
    rows = table(spark, d, "marker_registry").where("raw_column is not null and raw_column <> ''").select("raw_column", F.coalesce("note", F.lit("")).alias("note"))
    return files.csv_round_trip(rows).groupBy("raw_column", "note").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT upper(trim(cohort)) AS cohort, count(*) AS n_cells, count(DISTINCT image_id) AS n_images, count(DISTINCT patient_id) AS n_patients
FROM cells WHERE cohort IS NOT NULL GROUP BY 1""")
def json_sidecar(spark: SparkSession, d: str) -> DataFrame:
    """A5: per-cohort metadata written as JSON lines and read back with a declared schema."""
    meta = table(spark, d, "cells").where("cohort is not null").groupBy(F.upper(F.trim("cohort")).alias("cohort")).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct("image_id").alias("n_images"), F.count_distinct("patient_id").alias("n_patients")
    )
    return files.json_round_trip(meta)


@register(f"WITH {M} SELECT cohort, count(*) AS n FROM m WHERE cohort IN ('NORDA', 'OSTEL') GROUP BY 1")
def partitioned_sink(spark: SparkSession, d: str) -> DataFrame:
    """Parquet partitioned by cohort; the second read prunes partitions."""
    cells = standard_cells(spark, d).select("cohort", "cell_id")
    return files.partitioned(cells, "cohort").where(F.col("cohort").isin("NORDA", "OSTEL")).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT doc_id, sha256(text) AS digest, strlen(text)::BIGINT AS n_bytes FROM documents WHERE text IS NOT NULL""")
def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Size and SHA-256 of every text."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))


@register("""WITH v AS (SELECT paper_id, substr(sha256(text), 1, 16) AS digest, strlen(text)::BIGINT AS n_bytes, row_number() OVER (PARTITION BY paper_id ORDER BY doc_id) AS first,
row_number() OVER (PARTITION BY paper_id ORDER BY doc_id DESC) AS last FROM documents WHERE text IS NOT NULL AND paper_id IS NOT NULL),
a AS (SELECT paper_id, digest, n_bytes FROM v WHERE first = 1 AND digest < 'f'), b AS (SELECT paper_id, digest, n_bytes FROM v WHERE last = 1 AND digest > '1')
SELECT paper_id, CASE WHEN a.digest IS NULL THEN 'new' WHEN b.digest IS NULL THEN 'missing' WHEN a.n_bytes <> b.n_bytes THEN 'size' WHEN a.digest <> b.digest THEN 'digest' ELSE 'same' END AS state FROM a FULL JOIN b USING (paper_id)""")
def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """A stored manifest (size and truncated digest of each article's first text) against what there is now (its last
    text); texts with the highest digests aren't listed, and those with the lowest are gone, so that each state occurs."""
    texts = table(spark, d, "documents").where("text is not null and paper_id is not null").select("paper_id", "doc_id", F.sha2("text", 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes"))
    entry = F.struct(F.substring("sha", 1, 16).alias("digest"), "n_bytes")
    ends = texts.groupBy("paper_id").agg(F.min_by(entry, "doc_id").alias("a"), F.max_by(entry, "doc_id").alias("b"))
    stored = files.stored_manifest(ends.where("a.digest < 'f'").select("paper_id", "a.*"))
    return files.verify(stored, ends.where("b.digest > '1'").select("paper_id", "b.*"), "paper_id")


@register("SELECT DISTINCT raw_column AS marker, regexp_replace(upper(raw_column), '[^A-Z0-9]', '', 'g') IN (SELECT upper(symbol) FROM marker_reference) AS known FROM marker_registry WHERE trim(raw_column) <> '' AND raw_column NOT LIKE '%' || chr(10) || '%'")
def headerless_list(spark: SparkSession, d: str) -> DataFrame:
    """A3: a list of one column without a header, written and read by a declared schema; which of its names are known."""
    named = table(spark, d, "marker_registry").where("trim(raw_column) <> ''").where(~F.col("raw_column").contains("\n")).select("raw_column").distinct()
    symbols = table(spark, d, "marker_reference").select(F.upper("symbol").alias("symbol"), F.lit(True).alias("known")).where("symbol is not null").distinct()
    listed = files.list_round_trip(named, "marker")
    return listed.join(symbols, F.regexp_replace(F.upper("marker"), "[^A-Z0-9]", "") == F.col("symbol"), "left").select("marker", F.coalesce("known", F.lit(False)).alias("known"))


@register(f"WITH {M}, a AS (SELECT cohort, label, avg(area_px2) AS area, avg(raw_dnx) AS dnx, avg(raw_velk2) AS velk2, avg(raw_orsa1) AS orsa1, avg(raw_tamq4) AS tamq4 FROM m GROUP BY 1, 2)"
+ " UNION ALL ".join(f"SELECT cohort, label, {i} AS slot, round({m}, 6) AS value FROM a" for i, m in enumerate(MARKERS)).join([" ", ""]))
def dense_store(spark: SparkSession, d: str) -> DataFrame:
    """One dense array of marker means for each label, written and read back as arrays; an unmeasured slot stays NULL."""
    means = standard_cells(spark, d).groupBy("cohort", "label").agg(F.array(*[F.avg(c) for c in MARKERS.values()]).alias("means"))
    return cut(means, "dense").select("cohort", "label", F.posexplode("means").alias("slot", "value")).withColumn("value", fixed("value", 6))


@register()
def crc_manifest(spark: SparkSession, d: str) -> DataFrame:
    """H7: CRC-32 and size of every text (no SQL)."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"), F.octet_length("text").cast("long").alias("n_bytes"))


@register("SELECT DISTINCT resolved_id FROM marker_registry WHERE resolved_id IS NOT NULL AND resolved_id NOT IN (SELECT canon_id FROM marker_reference)")
def offline_misses(spark: SparkSession, d: str) -> DataFrame:
    """Keys that the cached lookup lacks."""
    wanted = table(spark, d, "marker_registry").where("resolved_id is not null").select("resolved_id").distinct()
    cache = table(spark, d, "marker_reference").select(F.col("canon_id").alias("resolved_id"))
    return wanted.join(cache, "resolved_id", "left_anti")


@register(f"WITH {M} SELECT cohort, image_id, floor(x_px / 500)::BIGINT AS tile_x, floor(y_px / 500)::BIGINT AS tile_y, count(*) AS n FROM m WHERE x_px IS NOT NULL AND y_px IS NOT NULL GROUP BY ALL")
def tissue_series(spark: SparkSession, d: str) -> DataFrame:
    """The series behind a tissue figure, cells per tile."""
    cells = standard_cells(spark, d).where("x_px is not null and y_px is not null")
    return cells.groupBy("cohort", "image_id", F.floor(F.col("x_px") / 500).alias("tile_x"), F.floor(F.col("y_px") / 500).alias("tile_y")).agg(F.count(F.lit(1)).alias("n"))


@register(" UNION ALL ".join(f"SELECT '{c}' AS marker, count({c}) AS n FROM cells" for c in ("raw_dnx", "raw_velk2", "raw_orsa1")))
def marker_rules(spark: SparkSession, d: str) -> DataFrame:
    """B1: columns chosen by pattern, range and exclusion."""
    cells = table(spark, d, "cells")
    names = schema.resolve_columns(cells.columns, pattern="^raw_", exclude=["raw_tamq4"])
    wide = cells.agg(*[F.count(c).alias(c) for c in names])
    return wide.unpivot([], names, "marker", "n")


@register("SELECT cohort || '|' || coalesce(cell_id::VARCHAR, 'nan') AS uid, coalesce(native_label, 'unknown') AS label FROM cells WHERE cohort IS NOT NULL")
def id_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Globally unique ids, defaults for missing labels."""
    cells = table(spark, d, "cells").where("cohort is not null")
    return cells.select(F.concat_ws("|", "cohort", F.coalesce(F.col("cell_id").cast("string"), F.lit("nan"))).alias("uid"), F.coalesce("native_label", F.lit("unknown")).alias("label"))


@register(f"WITH {M} SELECT cohort, round(avg(m.area_px2 * c.px_um * c.px_um), 6) AS mean_um2, count(m.area_px2) AS n FROM m JOIN cohorts c USING (cohort) GROUP BY 1")
def area_units(spark: SparkSession, d: str) -> DataFrame:
    """Areas in square micrometres."""
    scale = table(spark, d, "cohorts").select("cohort", "px_um")
    cells = standard_cells(spark, d).join(scale, "cohort")
    return cells.groupBy("cohort").agg(fixed(F.avg(F.col("area_px2") * F.col("px_um") * F.col("px_um")), 6).alias("mean_um2"), F.count("area_px2").alias("n"))


@register("SELECT registry_id, row_number() OVER (ORDER BY registry_id) - 1 AS code FROM marker_registry")
def dense_ids(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids 0..n-1 over a declared order, without one task that sorts everything."""
    return schema.dense_ids(table(spark, d, "marker_registry").select("registry_id"), "registry_id", "code")


@register("SELECT load_id, count(*) AS n, count(*) FILTER (WHERE coalesce(raw_dnx, raw_velk2, raw_orsa1, raw_tamq4) IS NULL) AS n_empty FROM cells GROUP BY 1")
def null_audit(spark: SparkSession, d: str) -> DataFrame:
    """Rows without any marker."""
    empty = F.coalesce(*[c for m, c in MARKERS.items() if m != "area"]).isNull()
    return table(spark, d, "cells").groupBy("load_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(empty).alias("n_empty"))


@register(f"WITH {M} SELECT cohort, label, count(*) AS n, CASE WHEN count(*) >= 100 THEN 'kept' ELSE 'under 100 rows' END AS reason FROM m GROUP BY 1, 2")
def min_support_audit(spark: SparkSession, d: str) -> DataFrame:
    """Labels kept or dropped by support, with the reason."""
    counts = standard_cells(spark, d).groupBy("cohort", "label").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("reason", F.when(F.col("n") >= 100, "kept").otherwise("under 100 rows"))


@register(r"""SELECT CASE WHEN native_label IS NULL OR lower(trim(native_label)) IN ('', 'nan', 'none', 'null', 'na') THEN NULL
ELSE lower(trim(regexp_replace(native_label, '[\s_-]+', ' ', 'g'))) END AS label, count(*) AS n FROM cells GROUP BY 1""")
def label_standard(spark: SparkSession, d: str) -> DataFrame:
    """Labels in one spelling, stand-ins as NULL."""
    raw = F.col("native_label")
    return table(spark, d, "cells").groupBy(F.when(~null_like(raw), standard_label(raw)).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@register("""SELECT cohort, count(*) AS n, count(*) FILTER (WHERE regexp_matches(lower(patient_id), '[|](nan|unknown|<na>|-1)$')) AS n_unknown
FROM cells WHERE cohort IS NOT NULL GROUP BY 1""")
def unknown_patients(spark: SparkSession, d: str) -> DataFrame:
    """Ids that end in a mark for unknown."""
    unknown = F.lower("patient_id").rlike(r"[|](nan|unknown|<na>|-1)$")
    return table(spark, d, "cells").where("cohort is not null").groupBy("cohort").agg(F.count(F.lit(1)).alias("n"), F.count_if(unknown).alias("n_unknown"))


@register("""SELECT load_id, round(avg(least(1, greatest(0, CASE WHEN label_confidence::VARCHAR <> 'nan' THEN label_confidence::DOUBLE ELSE 1 END))), 6) AS mean_conf,
count(DISTINCT label_confidence) > 1 AS informative FROM cells GROUP BY 1""")
def confidence_clip(spark: SparkSession, d: str) -> DataFrame:
    """Confidence coerced into [0, 1], and whether it says anything."""
    x = F.col("label_confidence").cast("double")
    clipped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(null_number(x), 1.0).otherwise(x)))
    return table(spark, d, "cells").groupBy("load_id").agg(fixed(F.avg(clipped), 6).alias("mean_conf"), (F.count_distinct("label_confidence") > 1).alias("informative"))


_ORDER = "load_id, loaded_at, image_id NULLS FIRST, x_px NULLS FIRST, y_px NULLS FIRST, native_label NULLS FIRST"


@register(f"SELECT cell_id, load_id, image_id FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY {_ORDER}) AS rn FROM cells WHERE cell_id IS NOT NULL) WHERE rn = 1")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each cell in a declared order."""
    order = ["load_id", "loaded_at", *[F.asc_nulls_first(c) for c in ("image_id", "x_px", "y_px", "native_label")]]
    rows = table(spark, d, "cells").where("cell_id is not null")
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("cell_id").orderBy(*order))).where("rn = 1").select("cell_id", "load_id", "image_id")


@register("""SELECT load_id, round(100.0 * avg(CASE WHEN x_px IS NULL OR x_px::VARCHAR IN ('nan', 'inf', '-inf') THEN 1 ELSE 0 END), 6) AS pct_no_x,
round(100.0 * avg(CASE WHEN patient_id IS NULL THEN 1 ELSE 0 END), 6) AS pct_no_patient FROM cells GROUP BY 1""")
def missing_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of non-finite coordinates and missing patients."""
    x = F.col("x_px")
    bad = null_number(x) | (F.abs(x) == F.lit(float("inf")))
    return table(spark, d, "cells").groupBy("load_id").agg(
        fixed(100.0 * F.avg(bad.cast("int")), 6).alias("pct_no_x"), fixed(100.0 * F.avg(F.col("patient_id").isNull().cast("int")), 6).alias("pct_no_patient")
    )


@register("""SELECT cohort, cluster, count(*) AS n_labels, count(*) FILTER (WHERE unreliable) AS n_flagged, count(*) FILTER (WHERE unreliable) * 2 > count(*) AS flagged
FROM label_map GROUP BY 1, 2""")
def majority_flag(spark: SparkSession, d: str) -> DataFrame:
    """A class is flagged when more than half its weight is."""
    flagged = F.count_if("unreliable")
    return table(spark, d, "label_map").groupBy("cohort", "cluster").agg(
        F.count(F.lit(1)).alias("n_labels"), flagged.alias("n_flagged"), (flagged * 2 > F.count(F.lit(1))).alias("flagged")
    )
