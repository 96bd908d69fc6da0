"""Registered queries of the subpackage, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.tables import table

from .canonical import map_registry
from .encoding import encode_corpus
from .frequency import label_terms
from .grouping import slide_splits, tied_slides
from .leakage import leaks
from .percentiles import CELL_FIELDS, CELL_GROUPINGS, RadixPercentiles, cell_percentiles
from .splitting import piece_offsets, split_texts


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry, or none, of every registry row whose id isn't an entry's id as written."""
    reference = table(spark, d, "marker_reference")
    ids = reference.select(F.col("canon_id").alias("resolved_id"))
    return map_registry(table(spark, d, "marker_registry").join(ids, "resolved_id", "left_anti"), reference).select("registry_id", "canon_id")


def p1_mapped(spark: SparkSession, d: str) -> DataFrame:
    """Every registry row with its entry, the column that named it and the distance; '' where it denotes none."""
    return map_registry(table(spark, d, "marker_registry"), table(spark, d, "marker_reference"))


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    """Cells and slides of each label of a cohort and of each word, with its mark."""
    return label_terms(table(spark, d, "cells"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Labels and words that are too rare or too common."""
    return label_terms(table(spark, d, "cells")).where("mark is not null").select("scope", "term", "mark")


def p2_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Cells and slides of each label of a cohort, and of every run of up to three words."""
    return label_terms(table(spark, d, "cells"), phrase=3)


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every slide with its group and split."""
    return slide_splits(table(spark, d, "cells"), table(spark, d, "cohorts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Slides tied to a smaller slide, with the smallest of their group."""
    tied = tied_slides(table(spark, d, "cells"), table(spark, d, "cohorts"))
    return tied.where("image_id <> group_id").select(F.col("group_id").alias("image_a"), F.col("image_id").alias("image_b"))


def p5_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of area and markers by cohort and label, and by slide."""
    return cell_percentiles(table(spark, d, "cells"))


def p5_load_histograms(spark: SparkSession, d: str) -> DataFrame:
    """The per-load digit histograms that p5_percentiles combines."""
    return RadixPercentiles(table(spark, d, "cells"), CELL_GROUPINGS, CELL_FIELDS).histograms()


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, d, "documents"))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items that they repeat in part or in edited form: eight words aligned, or a run of twelve."""
    found = leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.where("longest_run >= 12 or (score >= 16 and covered >= 0.1)")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a document and an item of which it holds 12 consecutive words."""
    return leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).where("longest_run >= 12").select("doc_id", "item_id")


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of every oversized document, with their text."""
    return split_texts(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that had to be cut: those with a second piece."""
    return piece_offsets(table(spark, d, "documents")).where("piece_no = 1").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_mapped, p2_terms, p2_phrases, p2_found, p4_splits, p4_found, p5_percentiles, p5_load_histograms, p6_ids, p7_leaks, p7_found, p8_pieces, p8_found)}

#: For these tables: full-width forms and two blanks are all that NFKC changes in them.
_WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u00a0\u3000"
_PLAIN = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''") + "  "


def _terms_sql(phrase: int) -> str:
    return f"""
WITH base AS (SELECT cell_id, image_id, upper(trim(cohort)) AS cohort,
    trim(regexp_replace(lower(translate(native_label, '{_WIDE}', '{_PLAIN}')), '[\\s_\\-]+', ' ', 'g')) AS label
    FROM cells WHERE trim(cohort) <> '' AND native_label IS NOT NULL AND trim(image_id) <> ''),
good AS (SELECT *, string_split(label, ' ') AS w FROM base WHERE label NOT IN ('', 'nan', 'none', 'null', 'na')),
runs AS (SELECT DISTINCT label, array_to_string(w[i:i + k - 1], ' ') AS term FROM (SELECT DISTINCT label, w FROM good),
    unnest(range(1, len(w) + 1)) AS x(i), unnest(range(1, {phrase} + 1)) AS y(k) WHERE i + k - 1 <= len(w)),
terms AS (SELECT cohort AS scope, label AS term, cell_id, image_id FROM good
    UNION ALL SELECT '*', term, cell_id, image_id FROM good JOIN runs USING (label)),
slides AS (SELECT cohort AS scope, count(DISTINCT image_id) AS all_slides FROM good GROUP BY 1 UNION ALL SELECT '*', count(DISTINCT image_id) FROM good),
counts AS (SELECT scope, term, count(DISTINCT cell_id) AS n_cells, count(DISTINCT image_id) AS n_slides FROM terms GROUP BY 1, 2)
SELECT scope, term, n_cells, n_slides, all_slides, CASE WHEN n_slides < 3 OR (scope <> '*' AND n_cells < 5) THEN 'rare'
    WHEN n_slides > 0.9 * all_slides THEN 'common' END AS mark FROM counts JOIN slides USING (scope)"""


SQL: dict[str, str] = {
    "p2_terms": _terms_sql(1),
    "p2_phrases": _terms_sql(3),
    "p2_found": f"SELECT scope, term, mark FROM ({_terms_sql(1)}) WHERE mark IS NOT NULL",
    "p4_found": """
WITH RECURSIVE ids AS (SELECT DISTINCT image_id, upper(trim(patient_id)) AS patient FROM cells WHERE image_id IS NOT NULL AND patient_id IS NOT NULL
    AND lower(trim(patient_id)) NOT IN ('', 'nan', 'none', 'null', 'na') AND NOT regexp_matches(lower(trim(patient_id)), '[|](nan|unknown|<na>|-1)$')),
good AS (SELECT DISTINCT image_id, patient FROM ids JOIN cohorts ON upper(trim(cohort)) = split_part(patient, '|', 1)
    WHERE regexp_full_match(patient, '(?i)(?:' || patient_pattern || ')')),
near AS (SELECT DISTINCT p.image_id AS a, q.image_id AS b FROM good p JOIN good q USING (patient)),
reach AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b)
SELECT min(b) AS image_a, a AS image_b FROM reach GROUP BY a HAVING min(b) <> a""",
}
