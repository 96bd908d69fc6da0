"""Queries over whole tables: every load, marker and cohort, by brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow.parquet as pq

from tessella.queries import collect
from tessella.sources.standard import MARKERS, standard_cells

QUERIES = collect()[0]


def test_repeats_of_every_load(spark, tiny):
    rows = pq.read_table(f"{tiny}/cells.parquet", columns=["load_id", "cell_id"]).to_pylist()
    wanted = {k: n - 1 for k, n in Counter((r["load_id"], r["cell_id"]) for r in rows).items() if n > 1}
    got = {(r.load_id, r.cell_id): r.times for r in QUERIES["identity_guard_all"](spark, tiny).collect()}
    assert got == wanted and max(k[0] for k in got if k[0] is not None) > 2


def test_scan_of_every_load(spark, tiny):
    rows = pq.read_table(f"{tiny}/cells.parquet", columns=["cell_id", "area_px2"]).to_pylist()
    wanted = Counter(r["cell_id"] for r in rows if r["area_px2"] is not None and not r["area_px2"] <= 250)
    assert Counter(r.cell_id for r in QUERIES["scan_project_all"](spark, tiny).collect()) == wanted


def test_ranks_of_every_marker(spark, tiny):
    for name in ("ecdf_cohort_all", "ecdf_image_all"):
        assert {r.marker for r in QUERIES[name](spark, tiny).select("marker").distinct().collect()} == set(MARKERS)


def test_every_cohort_is_held_out(spark, tiny):
    got = {r.held_out: r.n for r in QUERIES["masked_marker_regression"](spark, tiny).collect()}
    cells = standard_cells(spark, tiny).where("raw_dnx is not null").groupBy("cohort").count()
    counts = {r.cohort: r["count"] for r in cells.collect()}
    cohorts = pq.read_table(f"{tiny}/cohorts.parquet", columns=["cohort"])["cohort"].to_pylist()
    assert got == {c: counts.get(c, 0) for c in cohorts} and len(got) == 8


def test_regression_uses_every_other_marker(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(400, 2))
    rows = [(i, "AB"[i % 2], "s", "p", 0.0, 0.0, "t", 1.0, float(a), 1.0, 1.0, 1.0, float(b), 1) for i, (a, b) in enumerate(np.c_[x[:, 0], x[:, 0]])]
    columns = ["cell_id", "cohort", "image_id", "patient_id", "x_px", "y_px", "native_label", "label_confidence", "raw_dnx", "area_px2", "raw_velk2", "raw_orsa1", "raw_tamq4", "load_id"]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/cells.parquet")
    spark.createDataFrame([("A",), ("B",)], ["cohort"]).write.parquet(f"{tmp_path}/cohorts.parquet")
    got = QUERIES["masked_marker_regression"](spark, str(tmp_path)).collect()
    assert {r.held_out for r in got} == {"A", "B"} and all(r.r2 > 0.9 for r in got)
