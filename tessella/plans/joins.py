"""Joins that hold for keys with a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .materialize import fits


def skew_join(big: DataFrame, small: DataFrame, on: list[str], spread: Column, how: str = "inner", rows: int = 100_000, salts: int = 16, hits: str | None = None) -> DataFrame:
    """``big`` joined with ``small``, whatever share of ``big`` one key holds.

    ``small`` is broadcast if it has at most ``rows`` rows and fits the driver; beyond that it is repeated ``salts``
    times, and the rows of a key of ``big`` are spread over the repeats by ``spread``.  ``hits``, a column of ``small``
    that isn't returned, has the rows of ``big`` with its key, of the same types there; then only keys of over a
    thousandth of all rows are repeated.  ``small`` is counted, so it should be a stored frame.
    """
    side = small.drop(hits) if hits else small
    if fits(side, rows):
        return big.join(F.broadcast(side), on, how)
    many, salt = F.lit(True), F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    if hits:
        total = small.agg(F.sum(hits)).first()[0] or 0
        hot = small.where(F.col(hits) > total / 1000).select(F.xxhash64(*on)).distinct()  # fewer than a thousand
        many = F.xxhash64(*on).isin([k for (k,) in hot.collect()])
    copies = F.when(many, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    # by a shuffle, since the planner takes the repeats to be as small as the file and broadcasts them
    salted = side.withColumn("_salt", F.explode(copies)).hint("merge")
    return big.withColumn("_salt", F.when(many, salt).otherwise(0)).join(salted, [*on, "_salt"], how).drop("_salt")
