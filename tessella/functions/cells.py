"""Rules for what counts as missing in the standard cell table."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no patient or label, and id endings that stand for an unknown patient.
STAND_INS = ("", "nan", "none", "null", "na")
UNKNOWN_ENDINGS = ("|nan", "|unknown", "|<na>", "|-1")


def no_patient(column: Column) -> Column:
    """Whether a patient id (trimmed, any case) is NULL or a stand-in for an unknown patient."""
    text = F.lower(F.trim(column))
    endings = F.lit(False)
    for ending in UNKNOWN_ENDINGS:
        endings = endings | text.endswith(ending)
    return column.isNull() | text.isin(*STAND_INS) | endings


def null_number(column: Column) -> Column:
    """Whether a number is NULL or NaN."""
    return column.isNull() | F.isnan(column)


def finite(column: Column) -> Column:
    """The number as double, or NULL where it is NULL, NaN or infinite."""
    x = column.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
