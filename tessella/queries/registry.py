"""Registration of queries, and the SQL fragments that most of their oracles begin with."""

from __future__ import annotations

from collections.abc import Callable

from tessella.functions.numbers import NUDGE
from tessella.sources.standard import MARKERS


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:  # the same nudge as in fixed()
                self.sql[f.__name__] = sql.replace("round(", f"round({NUDGE} + ")
            return f

        return add


def finite(c: str) -> str:
    """A number as double, NULL where it isn't finite; by its text, since file statistics may hide NaN."""
    return f"CASE WHEN {c}::VARCHAR NOT IN ('nan', 'inf', '-inf') THEN {c}::DOUBLE END"


_LABEL = r"lower(trim(regexp_replace(native_label, '[\s_-]+', ' ', 'g')))"
_NOTHING = "('', 'nan', 'none', 'null', 'na')"

#: The standard cells (m), their long form (l) and their ranks per cohort and marker (u).
M = (
    "m AS (SELECT cell_id, upper(trim(cohort)) AS cohort, image_id, patient_id, "
    f"{_LABEL} AS label, load_id, {finite('x_px')} AS x_px, {finite('y_px')} AS y_px, {finite('label_confidence')} AS conf, "
    + ", ".join(f"{finite(c)} AS {c}" for c in MARKERS.values())
    + " FROM cells WHERE cohort IS NOT NULL AND image_id IS NOT NULL AND native_label IS NOT NULL "
    + f"AND {_LABEL} NOT IN {_NOTHING})"
)
L = (
    M
    + ", l AS ("
    + " UNION ALL ".join(
        f"SELECT cell_id, cohort, image_id, label, conf, '{m}' AS marker, {c} AS v FROM m WHERE {c} IS NOT NULL" for m, c in MARKERS.items()
    )
    + ")"
)
U = (
    L
    + ", u AS (SELECT *, (rank() OVER (PARTITION BY cohort, marker ORDER BY v) + (count(*) OVER (PARTITION BY cohort, marker, v) - 1) / 2.0)"
    + " / count(*) OVER (PARTITION BY cohort, marker) AS u FROM l)"
)
