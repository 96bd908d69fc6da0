"""Declared checks: observed quantities against thresholds, guards that two frames agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELATIONS = {">=": lambda x, y: x >= y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, "<": lambda x, y: x < y, "==": lambda x, y: x == y}


def evaluate(observed: DataFrame, rules: list[tuple[str, str, float, bool]]) -> DataFrame:
    """``check``, ``value``, ``threshold``, ``required`` and PASS, FAIL or UNDECIDED for a one-row frame of quantities."""
    rows = []
    for name, relation, threshold, required in rules:
        value = F.col(name).cast("double")
        outcome = F.when(value.isNull(), "UNDECIDED").when(RELATIONS[relation](value, F.lit(threshold)), "PASS").otherwise("FAIL")
        rows.append(F.struct(F.lit(name).alias("check"), value.alias("value"), F.lit(float(threshold)).alias("threshold"), F.lit(required).alias("required"), outcome.alias("outcome")))
    return observed.select(F.inline(F.array(*rows)))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two frames has, with how often; empty if they are equal."""
    left = a.exceptAll(b).groupBy(*a.columns).agg(F.count(F.lit(1)).alias("times")).withColumn("only_in", F.lit("first"))
    right = b.exceptAll(a).groupBy(*a.columns).agg(F.count(F.lit(1)).alias("times")).withColumn("only_in", F.lit("second"))
    return left.unionByName(right)


def markdown(df: DataFrame, digits: int = 4) -> str:
    """A Markdown table of a report-sized frame, streamed row by row; NULL and NaN are blank."""

    def text(v) -> str:
        if v is None or v != v:
            return ""
        return f"{v:.{digits}f}" if isinstance(v, float) else str(v).replace("|", "\\|")

    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    lines += ["| " + " | ".join(map(text, row)) + " |" for row in df.toLocalIterator()]
    return "\n".join(lines)
