"""Rounding that doesn't depend on the order in which parts were summed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Far above the noise of sums, far below the digits kept: it takes values off the middle between two roundings.
NUDGE = 1e-10


def fixed(column: Column | str, digits: int = 0) -> Column:
    """``column`` rounded to ``digits``; values halfway go up whichever way their last bits fell."""
    return F.round((F.col(column) if isinstance(column, str) else column) + F.lit(NUDGE), digits)
