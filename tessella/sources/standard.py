"""The standard cell table: one spelling per cohort and label, non-finite numbers as NULL, and its long form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.cells import STAND_INS, finite
from tessella.plans.materialize import compute_or_load, cut

from .tables import table

MARKERS = {"area": "area_px2", "dnx": "raw_dnx", "velk2": "raw_velk2", "orsa1": "raw_orsa1", "tamq4": "raw_tamq4"}


def standard_label(column: Column) -> Column:
    """Lower case, with runs of white space, ``_`` and ``-`` as one space, trimmed."""
    spaced = F.translate(column, "\t\n\x0b\f\r_-", " " * 7)
    return F.lower(F.trim(F.when(spaced.contains("  "), F.regexp_replace(spaced, " +", " ")).otherwise(spaced)))


def null_like(column: Column) -> Column:
    """Whether a text is NULL or stands for nothing."""
    return column.isNull() | F.lower(F.trim(column)).isin(*STAND_INS)


def standard_cells(spark: SparkSession, d: str) -> DataFrame:
    """Rows that name a cohort, a slide and a label; repeats are kept, other rows are dropped."""
    cells = table(spark, d, "cells")
    label = standard_label(F.col("native_label"))
    return cells.where(
        F.col("cohort").isNotNull() & F.col("image_id").isNotNull() & F.col("native_label").isNotNull() & ~label.isin(*STAND_INS)
    ).select(
        "cell_id", F.upper(F.trim("cohort")).alias("cohort"), "image_id", "patient_id", label.alias("label"), "load_id",
        finite(F.col("x_px")).alias("x_px"), finite(F.col("y_px")).alias("y_px"), finite(F.col("label_confidence")).alias("conf"),
        *[finite(F.col(c)).alias(c) for c in MARKERS.values()],
    )


def long_values(cells: DataFrame, *keys: str) -> DataFrame:
    """``keys``, ``marker`` and ``v`` for every measured value; what isn't measured has no row."""
    pairs = F.array(*[F.struct(F.lit(m).alias("marker"), F.col(c).alias("v")) for m, c in MARKERS.items()])
    return cells.select(*keys, F.inline(pairs)).where("v is not null")


def value_counts(cells: DataFrame, *keys: str) -> DataFrame:
    """Rows of each distinct value per ``keys`` and marker: what ranks and quantiles need of the rows.

    Ranks read it more than once, so it is written once instead of being counted from the rows each time.
    """
    return cut(_counts(cells, *keys), "counts")


def _counts(cells: DataFrame, *keys: str) -> DataFrame:
    return long_values(cells, *keys).groupBy(*keys, "marker", "v").agg(F.count(F.lit(1)).alias("n"))


def stored_counts(spark: SparkSession, d: str, *keys: str) -> DataFrame:
    """``value_counts`` of the standard cells below ``d``, shared by all queries of the session."""
    return compute_or_load(spark, "-".join(("counts", *keys)), [f"{d}/cells.parquet"], lambda: _counts(standard_cells(spark, d), *keys))
