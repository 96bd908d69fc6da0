"""Column profiles and load comparison on planted loads."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest

from tessella.operators import quality

SCHEMA = "cell_id long, cohort string, image_id string, patient_id string, x_px double, area_px2 double, label_confidence float, load_id int, grid string, n string"
LOADS = "load_id int, baseline_load_id int"


@pytest.fixture(scope="module")
def cohorts(spark):
    return spark.createDataFrame([("A", r"A\|P\d{3}"), ("B", None)], "cohort string, patient_pattern string")


def load(number, n=400, shift=0.0, patient="A|P001", conf=0.5, seed=0):
    rng = np.random.default_rng(seed)
    return [(number * 10_000 + i, "A", "s", patient, float(i), float(a), conf, number, "clash", None) for i, a in enumerate(rng.uniform(10, 100, n) + shift)]


def found(spark, rows, loads, cohorts):
    cells = spark.createDataFrame(rows, SCHEMA)
    got = quality.load_issues(cells, spark.createDataFrame(loads, LOADS), cohorts)
    return sorted(tuple(r) for r in got.collect())


def test_equal_loads_have_no_issue(spark, cohorts):
    assert found(spark, load(1) + load(2, seed=1), [(1, None), (2, 1)], cohorts) == []


def test_planted_issues(spark, cohorts):
    rows = load(1) + load(2, shift=40, seed=1) + load(3, seed=2) + load(4, seed=3) + load(5, seed=4)
    rows += [(1, "A", "s", "A|x", 0.0, 50.0, 0.5, 3, None, None), (2, "A", "s", "C|P001", 0.0, 50.0, 0.5, 4, None, None)]
    rows += [(3, "A", "s", "A|unknown", 0.0, float("inf"), float("nan"), 5, None, None)] + [(4, "A", "s", None, 0.0, None, 2.0, 5, None, None)] * 40
    got = found(spark, rows, [(1, None), (2, 1), (3, 1), (4, 1), (5, 1)], cohorts)
    assert got == [
        (2, "area_px2", "drift"), (3, "patient_id", "pattern"), (4, "patient_id", "pattern"),
        (5, "area_px2", "null_rate"), (5, "area_px2", "range"), (5, "label_confidence", "range"), (5, "patient_id", "null_rate"),
    ]


def test_drift_is_exact_at_the_limit(spark, cohorts):
    base = [(i, "A", "s", None, float(i), float(1 + i % 10), 0.5, 1, None, None) for i in range(100)]
    # moving 20 of 100 values from the lowest to above the highest makes a difference of exactly 0.2, which is no drift
    exact = [(*r[:5], 20.0 if r[0] % 10 < 2 else r[5], *r[6:7], 2, *r[8:]) for r in base]
    more = [(*r[:5], 20.0 if r[0] % 10 < 3 else r[5], *r[6:7], 3, *r[8:]) for r in base]
    got = found(spark, base + exact + more, [(1, None), (2, 1), (3, 1)], cohorts)
    assert ("drift" in {g[2] for g in got if g[0] == 3}) and "drift" not in {g[2] for g in got if g[0] == 2}


def test_constant_columns_and_tiny_loads(spark, cohorts):
    rows = load(1, n=1) + load(2, n=1, shift=1000) + [(9, None, None, None, None, None, None, None, None, None)]
    got = found(spark, rows, [(1, None), (2, 1), (3, 1), (None, 1)], cohorts)
    assert got == [(2, "area_px2", "drift")]


def test_empty(spark, cohorts):
    assert found(spark, [], [], cohorts) == []
    assert quality.profile_columns(spark.createDataFrame([], SCHEMA)).count() == 0


def test_difference_matches_sorting(spark, cohorts):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.lognormal(3, 1, 700), 1), np.round(rng.lognormal(3.4, 1, 500), 1)
    rows = [(i, "A", "s", None, float(i), float(x), 0.5, load_id, None, None) for load_id, part in ((1, a), (2, b)) for i, x in enumerate(part)]
    got = quality.distribution_changes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, None), (2, 1)], LOADS), cohorts)
    grid = np.union1d(a, b)
    ks = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    row = got.where("column_name = 'area_px2'").first()
    if row.difference is None:
        assert ks <= 0.2
    else:
        assert row.difference == pytest.approx(ks) and row.drift == (ks > 0.2)


def test_difference_beside_a_bin_of_ties(spark, cohorts):
    rng = np.random.default_rng(6)
    # half of both loads is one value, whose bin has the greatest bound and hardly any difference
    a, b = np.r_[rng.uniform(0, 70, 600), [100.0] * 600], np.r_[70 * rng.beta(1.5, 1, 600), [100.0] * 600]
    rows = [(i, "A", "s", None, float(i), float(x), 0.5, load_id, None, None) for load_id, part in ((1, a), (2, b)) for i, x in enumerate(part)]
    got = quality.distribution_changes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, None), (2, 1)], LOADS), cohorts)
    ks = max(abs((a <= v).mean() - (b <= v).mean()) for v in np.union1d(a, b))
    row = got.where("column_name = 'area_px2'").first()
    assert 0.05 < ks < 0.2 and row.difference == pytest.approx(ks) and not row.drift


def test_classifier_tells_columns_apart(spark, cohorts):
    rows = load(1, n=800) + load(2, n=800, shift=60, seed=7)
    got = quality.distribution_changes(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(1, None), (2, 1)], LOADS), cohorts)
    r = {x.column_name: x for x in got.collect()}
    assert r["area_px2"].auc_alone > 0.8 and r["area_px2"].auc_lost > 0.2
    assert abs(r["label_confidence"].auc_alone - 0.5) < 0.05 and abs(r["label_confidence"].auc_lost) < 0.05


def test_profile(spark):
    rows = [(1, 2.0, "b", dt.datetime(2031, 1, 1)), (1, float("nan"), None, None), (1, float("inf"), "a", None), (None, None, None, None)]
    got = {(r.load_id, r.column_name): r for r in quality.profile_columns(spark.createDataFrame(rows, "load_id int, x double, s string, t timestamp")).collect()}
    x, s = got[1, "x"], got[1, "s"]
    assert (x.n_rows, x.n_null, x.n_distinct, x.min_value, x.max_value) == (3, 1, 2, 2.0, float("inf"))
    assert (s.n_null, s.n_distinct, s.min_text, s.max_text) == (1, 2, "a", "b")
    assert got[None, "x"].n_null == 1


SHAPES = {
    "shift": lambda r, n: (r.normal(50, 10, n), r.normal(50 + r.uniform(4, 8), 10, n)),
    "spread": lambda r, n: (r.normal(50, 5, n), r.normal(50, r.uniform(11, 16), n)),
    "part": lambda r, n: (r.lognormal(3, 0.5, n), np.where(r.random(n) < r.uniform(0.15, 0.35), r.lognormal(5, 0.2, n), r.lognormal(3, 0.5, n))),
    "neighbours": lambda r, n: (np.round(r.uniform(0, 10, n)), np.where(r.random(n) < 0.27, np.minimum(np.round(r.uniform(0, 10, n)) + 2.0, 10.0), np.round(r.uniform(0, 10, n)))),
    "atom": lambda r, n: (np.where(r.random(n) < 0.3, 7.01, r.uniform(0, 14, n)), np.where(r.random(n) < 0.3, 7.02, r.uniform(0, 14, n))),
    "two sides": lambda r, n: (r.uniform(30, 70, n), np.where(r.random(n) < 0.5, r.uniform(0, 45, n), r.uniform(55, 100, n))),
    "equal": lambda r, n: (r.normal(50, 10, n), r.normal(50, 10, n)),
    "same": lambda r, n: (np.full(n, 5.0), np.full(n, 5.0)),
}


def test_classifier_leaves_out_no_drift(spark, cohorts):
    r, cells, loads, wanted = np.random.default_rng(11), [], [], set()
    for k, (shape, n) in enumerate((s, n) for s in SHAPES for n in (60, 250, 900, 2500)):
        base, new = 2 * k + 1, 2 * k + 2
        a, b = (np.abs(x) + 0.01 for x in SHAPES[shape](r, n))
        loads += [(base, None), (new, base)]
        grid = np.union1d(a, b)
        if np.abs(np.searchsorted(np.sort(a), grid, "right") - np.searchsorted(np.sort(b), grid, "right")).max() * 5 > n:
            wanted.add(new)
        cells += [(i, "A", "s", "A|P001", float(i), float(v), 0.5, load_id, None, None) for load_id, part in ((base, a), (new, b)) for i, v in enumerate(part)]
    got = found(spark, cells, loads, cohorts)
    assert {g[0] for g in got if g[2] == "drift"} == wanted and len(wanted) > 15


def test_without_the_classifier_there_is_no_drift(spark, cohorts, monkeypatch):
    from pyspark.sql import functions as F

    rows, loads = load(1, n=3000) + load(2, n=3000, shift=40, seed=1), [(1, None), (2, 1)]
    assert found(spark, rows, loads, cohorts) == [(2, "area_px2", "drift")]
    seen = quality.discriminate
    monkeypatch.setattr(quality, "discriminate", lambda scored: seen(scored).withColumns({"auc_alone": F.lit(0.5), "gap_alone": F.lit(0.0)}))
    assert found(spark, rows, loads, cohorts) == []


def test_training_decides(spark, cohorts, monkeypatch):
    from pyspark.sql import functions as F

    rows, loads = load(1, n=3000) + load(2, n=3000, shift=40, seed=1), [(1, None), (2, 1)]
    trained = quality.column_scores
    monkeypatch.setattr(quality, "column_scores", lambda bins: trained(bins).withColumn("score", F.lit(0.0)))
    assert found(spark, rows, loads, cohorts) == []
