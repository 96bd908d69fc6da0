"""Label frequencies, tied slides and percentiles against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from tessella.llm.frequency import label_terms, standard_label
from tessella.llm.grouping import assign_splits, components, shared_out, slide_splits, tied_slides
from tessella.llm.percentiles import CELL_FIELDS, CELL_GROUPINGS, RadixPercentiles, cell_percentiles, key_value, order_key

CELLS = "cell_id long, image_id string, cohort string, native_label string, patient_id string, area_px2 double, raw_dnx float, raw_velk2 float, raw_orsa1 float, raw_tamq4 float, load_id int, term string, node string, prefix long"


def cell(i, image="A|1", cohort="A", label="t cell", patient="A|P001", area=1.0, dnx=1.0, load=1):
    return (i, image, cohort, label, patient, area, dnx, None, float("nan"), float("inf"), load, "clash", "clash", 1)


def frame(spark, rows):
    return spark.createDataFrame(rows, CELLS)


def test_terms_by_brute_force(spark):
    r = random.Random(3)
    labels = ["T Cell", "t_cell", "B  cell", "mast", "NA", "", None, "ｆａｔ cell", "cell cell", "x-y z"]
    rows = [cell(r.randrange(150), f"A|{r.randrange(9)}", r.choice(["A", " a", "B", None]), r.choice(labels)) for _ in range(600)]
    rows += rows[:50] + [cell(None, "A|1", "A", "mast"), cell(7, None, "A", "mast")]
    cells_of, slides_of, counted = defaultdict(set), defaultdict(set), defaultdict(set)
    for c in rows:
        lab = standard_label(c[3]) if c[3] is not None else ""
        if lab in ("", "na") or not c[2] or not c[1]:
            continue
        cohort = c[2].strip().upper()
        counted[cohort].add(c[1])
        counted["*"].add(c[1])
        for scope, term in [(cohort, lab), *(("*", w) for w in set(lab.split(" ")))]:
            slides_of[scope, term].add(c[1])
            cells_of[scope, term] |= {c[0]} - {None}
    got = {(x.scope, x.term): x for x in label_terms(frame(spark, rows), salt_classes=20).collect()}
    assert set(got) == set(slides_of)
    for key, x in got.items():
        s, n = len(slides_of[key]), len(cells_of[key])
        few = s < 3 or (key[0] != "*" and n < 5)
        mark = "rare" if few else "common" if s > 0.9 * len(counted[key[0]]) else None
        assert (x.n_cells, x.n_slides, x.mark) == (n, s, mark), key
    grams = label_terms(frame(spark, rows), phrase=2)
    assert grams.where("scope = '*' and term = 't cell'").first().n_slides == len(slides_of["A", "t cell"] | slides_of["B", "t cell"])


def test_terms_empty(spark):
    assert label_terms(frame(spark, [])).count() == 0


@pytest.mark.parametrize("per_task", [10, 25, 500_000])
def test_components(spark, per_task):
    r = random.Random(per_task)
    edges = [(f"n{r.randrange(60):02d}", f"n{r.randrange(60):02d}") for _ in range(45)] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(30)] + [("h", f"h{i}") for i in range(20)] + [(None, "x")]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        return x if parent[x] == x else find(parent[x])

    for a, b in edges:
        if a and b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a string, b string"), per_task).collect()}
    assert got == {x: find(x) for x in parent}


@pytest.mark.parametrize("form", ["hub", "path", "cliques"])
def test_levels_shrink_and_tasks_are_bounded(spark, form):
    from pyspark.sql import functions as F

    from tessella.llm import grouping

    n, limit = 20_000, 4_000
    if form == "hub":
        edges, groups = spark.range(n).selectExpr("'hub' as a", "concat('n', id) as b"), 1
    elif form == "path":  # names in no order, so that neighbours are never in one share
        edges, groups = spark.range(n).selectExpr("md5(string(id)) as a", "md5(string(id + 1)) as b"), 1
    else:
        edges, groups = spark.range(n).selectExpr("concat('x', id % 500, '-', id % 7) as a", "concat('x', id % 500, '-', id % 11) as b"), 500
    counts, shares = [], []
    forests, shared = grouping._forests, grouping._shares

    def seen(level, rows, per_task):
        counts.append(rows)
        parts = shared(level, rows, per_task)
        shares.extend(r["count"] for r in parts.groupBy(F.spark_partition_id()).count().collect())
        return forests(level, rows, per_task)

    grouping._forests = seen
    try:
        got = components(edges, limit)
        assert got.select("root").distinct().count() == groups
        assert got.count() == edges.selectExpr("explode(array(a, b))").distinct().count()
        assert got.groupBy("root").agg(F.min("node").alias("least")).where("root <> least").isEmpty()
    finally:
        grouping._forests = forests
    assert max(shares, default=0) <= limit and all(y < x for x, y in zip(counts, counts[1:]))


COHORTS = [("A", r"A\|P\d{3}"), ("B", r"B\|\d+")]


def test_ties(spark):
    rows = [
        cell(1, "A|1", patient="A|P001"), cell(2, "A|2", patient=" a|p001 "), cell(3, "B|9", "B", patient="A|P001"), cell(4, "A|3", patient="A|unknown"), cell(5, "A|4", patient="A|unknown"),
        cell(6, "A|5", patient="bad"), cell(7, "A|6", patient="bad"), cell(8, None, patient="A|P001"), cell(9, "A|7", patient=None), cell(10, "A|2", patient="B|12"), cell(11, "B|8", "B", patient="b|12"),
    ]
    cohorts = spark.createDataFrame(COHORTS, "cohort string, patient_pattern string")
    got = {r.image_id: r.group_id for r in tied_slides(frame(spark, rows), cohorts).collect()}
    assert got == {"A|1": "A|1", "A|2": "A|1", "B|9": "A|1", "B|8": "A|1", "A|3": "A|3", "A|4": "A|4", "A|5": "A|5", "A|6": "A|6", "A|7": "A|7"}
    assert tied_slides(frame(spark, []), cohorts).count() == 0 == slide_splits(frame(spark, []), cohorts).count()


def test_splits_hold_groups_and_shares(spark):
    r = random.Random(5)
    rows = []
    for cohort, n in (("A", 100), ("B", 50)):
        for i in range(n):
            patient = f"A|P{r.randrange(40):03d}" if cohort == "A" else f"B|{r.randrange(20)}"
            rows.append(cell(i, f"{cohort}|{i:03d}", cohort, patient=patient))
    rows.append(cell(999, "B|000", "B", patient="A|P001"))
    got = slide_splits(frame(spark, rows), spark.createDataFrame(COHORTS, "cohort string, patient_pattern string")).collect()
    assert len(got) == len({x.image_id for x in got}) == 150
    by_group = defaultdict(set)
    for x in got:
        by_group[x.group_id].add(x.split)
    assert all(len(s) == 1 for s in by_group.values())
    for cohort, n in (("A", 100), ("B", 50)):
        share = {s: sum(x.cohort == cohort and x.split == s for x in got) / n for s in ("train", "validation", "test")}
        assert share == pytest.approx({"train": 0.68, "validation": 0.12, "test": 0.2}, abs=0.06)


def test_equal_groups_are_shared_out(spark):
    slides = spark.createDataFrame([(f"s{i}", f"s{i}", None if i % 2 else "A") for i in range(200)], "image_id string, group_id string, cohort string")
    n = {r.split: r["count"] for r in assign_splits(slides, bucket_rows=45).groupBy("split").count().collect()}
    assert n == {"train": 136, "validation": 24, "test": 40}


def test_sharing_out_equals_one_by_one():
    r = random.Random(1)
    for _ in range(300):
        lead, step, n = [r.choice([r.uniform(-50, 300), float(r.randrange(100))]) for _ in range(3)], float(r.choice([1, 4, 9])), r.randrange(1, 200)
        left, counts = lead[:], [0, 0, 0]
        for _ in range(n):
            best = max(range(3), key=lambda s: lead[s] - counts[s] * step)
            counts[best] += 1
        assert sum(shared_out(lead, step, n)) == n and shared_out(lead, step, n) == counts, (lead, step, n, left)


def test_many_equal_groups(spark):
    slides = spark.range(1_000_000).selectExpr("concat('s', id) as image_id", "concat('s', id) as group_id", "'A' as cohort")
    n = {r.split: r["count"] for r in assign_splits(slides).groupBy("split").count().collect()}
    assert n == {"train": 680_000, "validation": 120_000, "test": 200_000}


def test_keys_keep_order():
    for kind in (np.float32, np.float64):
        v = np.sort(np.array([-np.finfo(kind).max, -3.5, -1e-30, -0.0, 0.0, 1e-30, 0.1, 2.0, np.finfo(kind).max], kind))
        k = order_key(v)
        assert (np.diff(k)[np.diff(v) > 0] > 0).all() and k[3] == k[4]
        assert (key_value(k, v.dtype.itemsize * 8) == v.astype(np.float64)).all()


def check(rows, got, error):
    groups = defaultdict(list)
    for c in rows:
        for f, v in zip(CELL_FIELDS, c[5:10]):
            if v is not None and np.isfinite(v):
                v = float(np.float32(v)) if f != "area_px2" else v
                groups["label", c[2], c[3], f].append(v)
                groups["image", c[1], None, f].append(v)
    seen = {(r.kind, r.g1, r.g2, r.field) for r in got}
    assert seen == set(groups) and len(got) == 7 * len(groups)
    for r in got:
        v = np.sort(groups[r.kind, r.g1, r.g2, r.field])
        rank = max(1, int(np.ceil(r.percentile * len(v) / 100)))
        lo, hi = np.searchsorted(v, r.value, "left"), np.searchsorted(v, r.value, "right")
        assert lo < hi and r.total == len(v)
        assert max(0, lo + 1 - rank, rank - hi) <= error * len(v)


def test_percentiles(spark):
    g = np.random.default_rng(2)
    rows = [cell(i, f"A|{i % 4}" if i % 9 else None, "A", "hot" if i % 3 else None, area=float(g.normal(0, 50)) if i % 2 else 0.0, dnx=float(g.lognormal(3, 2)), load=i % 5) for i in range(3000)]
    rows += [cell(1, "A|one", "B", "single", area=-7.25)] + [cell(2, "A|same", "B", "same", area=3.0)] * 40
    got = cell_percentiles(frame(spark, rows)).collect()
    check(rows, got, 0.005)
    exact = cell_percentiles(frame(spark, rows), error=0.0).collect()
    check(rows, exact, 0.0)
    digits = RadixPercentiles(frame(spark, rows), CELL_GROUPINGS, CELL_FIELDS)
    for small in (0, 150):
        check(rows, digits.compute(small=small).collect(), 0.005)


def test_percentiles_from_parts(spark):
    g = np.random.default_rng(3)
    rows = [cell(i, "A|1", "A", "x", area=float(g.normal()), load=i % 2) for i in range(500)]
    groupings = {"label": ("cohort", "native_label"), "image": ("image_id",)}
    parts = [RadixPercentiles(frame(spark, [c for c in rows if c[10] == k]), groupings, CELL_FIELDS).histograms() for k in (0, 1)]
    whole = RadixPercentiles(frame(spark, rows), groupings, CELL_FIELDS)
    check(rows, whole.compute(histograms=parts[0].unionByName(parts[1])).collect(), 0.005)
    assert cell_percentiles(frame(spark, [])).count() == 0
    assert cell_percentiles(frame(spark, [cell(1, area=None, dnx=float("nan"))])).count() == 0


def test_percentiles_of_stored_loads(spark):
    g = np.random.default_rng(4)
    rows = [cell(i, f"A|{i % 2}", "A", "x" if i % 5 else None, area=float(g.normal(40, 1)) if i % 3 else 7.0, dnx=float(g.lognormal(0, 0.1)), load=None if i % 7 == 0 else i % 7) for i in range(9000)]
    groupings = {"label": ("cohort", "native_label"), "image": ("image_id",)}
    made = [RadixPercentiles(frame(spark, [c for c in rows if c[10] == k]).coalesce(1), groupings, CELL_FIELDS).histograms() for k in (None, *range(1, 7))]
    stored = made[0]
    for one in made[1:]:
        stored = stored.unionByName(one)
    stored = spark.createDataFrame(stored.collect(), stored.schema)
    assert stored.count() < 0.1 * len(rows) and sum(len(r.bins) for r in stored.collect()) < 0.7 * 4 * len(rows)
    no_rows = RadixPercentiles(frame(spark, []), groupings, CELL_FIELDS)
    check(rows, no_rows.compute(histograms=stored).collect(), 0.005)
