"""Schema rules: column sets, required columns, unique keys, dense ids."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def require(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` with these columns only; an error names those it lacks."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*names)


def resolve_columns(available: list[str], pattern: str | None = None, between: tuple[str, str] | None = None, names: list[str] | None = None, exclude: list[str] = ()) -> list[str]:
    """Columns by name, as a stretch from one to another, or by a regular expression found in their names; less the excluded ones."""
    place = {n: k for k, n in enumerate(available)}
    lacking = [n for n in (*(names or ()), *(between or ())) if n not in place]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    if between and place[between[0]] > place[between[1]]:
        raise ValueError(f"the columns from {between[0]} to {between[1]} run backwards")
    stretch = range(place[between[0]], place[between[1]] + 1) if between else ()
    wanted = names if names is not None else [n for n in available if (place[n] in stretch if between else re.search(pattern or "", n))]
    return [n for n in wanted if n not in exclude]


def no_clash(df: DataFrame, added: list[str]) -> None:
    """An error if a column to be added is there already, in any case."""
    there = {c.lower() for c in df.columns}
    clash = [a for a in added if a.lower() in there]
    if clash:
        raise ValueError(f"columns exist already: {', '.join(clash)}")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; an error names one repeated key."""
    twice = df.groupBy(*keys).count().where("count > 1").first()
    if twice is not None:
        raise ValueError(f"key {keys} is not unique: {twice.asDict()}")
    return df


def dense_ids(df: DataFrame, order: str, name: str, shares: int = 64) -> DataFrame:
    """``df`` with its position 0..n-1 in ``order``; ties are broken arbitrarily, NULL comes first.

    The order is cut into shares at quantiles, for texts at those of their first seven bytes; each share numbers its own
    rows and adds the rows of the shares before.
    """
    place = F.col(order)
    if isinstance(df.schema[order].dataType, T.StringType):  # bytes compare as the texts do
        place = F.conv(F.rpad(F.hex(F.substring(F.encode(order, "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    levels = [i / shares for i in range(1, shares)]
    edges = df.agg(F.percentile_approx(place, levels, 1_000).alias("e")).first()["e"] or []
    share = F.lit(0)
    for e in sorted(set(edges)):
        share = share + (place > F.lit(e)).cast("int")
    placed = df.withColumn("_share", F.coalesce(share, F.lit(-1)))
    sizes = placed.groupBy("_share").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_share", (F.sum("_n").over(Window.orderBy("_share")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_share").orderBy(order)) - 1
    return placed.withColumn("_own", own).join(offsets, "_share").withColumn(name, F.col("_own") + F.col("_before")).drop("_share", "_own", "_before")


def misaligned(frozen: DataFrame, rebuilt: DataFrame, key: str) -> DataFrame:
    """``key``, its place ``frozen`` and ``rebuilt``, and ``state``: kept, moved, added or lost."""
    state = F.when(F.col("frozen").isNull(), "added").when(F.col("rebuilt").isNull(), "lost").when(F.col("frozen") == F.col("rebuilt"), "kept").otherwise("moved")
    return frozen.join(rebuilt, key, "full").select(key, "frozen", "rebuilt", state.alias("state"))
