"""Hand-made frames with ties, NULLs, constants, single rows and empty tables, and their known answers."""

from __future__ import annotations

import itertools

import numpy as np
import pytest

from tessella.functions.cells import finite, no_patient
from tessella.operators import alignment, evaluation, gates, graphs, linkage, ranks, sampling, schema, series
from tessella.sources.standard import standard_label


def counts(spark, values, group="g"):
    return spark.createDataFrame([(group, float(v), n) for v, n in values], "g string, v double, n long")


def test_mid_rank_ties(spark):
    got = {r.v: r.u for r in ranks.mid_rank(counts(spark, [(1, 1), (2, 2), (3, 1)]), ["g"]).collect()}
    assert got == {1.0: 0.25, 2.0: 0.625, 3.0: 1.0}


def test_mid_rank_constant_and_mean(spark):
    assert ranks.mid_rank(counts(spark, [(4, 3)]), ["g"]).first().u == pytest.approx(2 / 3)
    many = [(v / 7 - 3, 1 + v % 3) for v in range(60)]
    rows = ranks.mid_rank(counts(spark, many), ["g"]).collect()
    n = sum(r.n for r in rows)
    assert sum(r.u * r.n for r in rows) / n == pytest.approx((n + 1) / (2 * n))


def test_mid_rank_empty(spark):
    assert ranks.mid_rank(counts(spark, []), ["g"]).count() == 0


def test_quantiles_match_numpy(spark):
    values = [-5.5, -0.1, 0.0, 0.0, 0.0, 1e-9, 2.0, 3.5, 1e6]
    rows = spark.createDataFrame([("g", v, 1) for v in values], "g string, v double, n long")
    got = ranks.quantiles(rows, ["g"], [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]).first()
    assert got.rows == len(values)
    assert got.q == pytest.approx(list(np.quantile(values, [0.0, 0.1, 0.25, 0.5, 0.9, 1.0])))


def test_auroc_extremes(spark):
    perfect = spark.createDataFrame([("g", "a", 2.0, 3), ("g", "b", 1.0, 4)], "g string, label string, v double, n long")
    got = {r.label: r.auroc for r in evaluation.auroc_of_labels(perfect, ["g"], "label", 1, 0.5).collect()}
    assert got == {"a": 1.0, "b": 0.0}
    tied = spark.createDataFrame([("g", "a", 1.0, 3), ("g", "b", 1.0, 4)], "g string, label string, v double, n long")
    assert {r.auroc for r in evaluation.auroc_of_labels(tied, ["g"], "label", 1, 0.5).collect()} == {0.5}


def test_f1_of_absent_class(spark):
    pairs = spark.createDataFrame([("a", "a", 2), ("a", "c", 2)], "truth string, pred string, n long").selectExpr("1 as k", "*")
    rows = evaluation.class_scores(pairs, ["k"]).collect()
    assert [r["class"] for r in rows] == ["a"] and rows[0].f1 == pytest.approx(2 / 3) and rows[0].prec == 1.0


def test_rand_index_extremes(spark):
    same = spark.createDataFrame([(1, "x", 5), (2, "y", 7)], "a int, b string, w long")
    assert evaluation.adjusted_rand(same, "a", "b", "w").first().ari == 1.0
    one = spark.createDataFrame([(1, "x", 5), (1, "y", 7)], "a int, b string, w long")
    assert evaluation.adjusted_rand(one, "a", "b", "w").first().ari == 0.0
    assert evaluation.adjusted_rand(one.limit(0), "a", "b", "w").first().ari == 0.0


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (3, 5), (5, 3), (4, 4)])
def test_assignment_is_best(shape):
    rng = np.random.default_rng(shape[0] * 10 + shape[1])
    for _ in range(20):
        gain = rng.integers(0, 9, shape).astype(float)
        got = sum(gain[i, j] for i, j in evaluation._assign(gain))
        small, large = sorted(shape)
        wide = gain if shape[0] <= shape[1] else gain.T
        assert got == max(sum(wide[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), small))


def test_average_linkage_by_hand():
    # a-b at 1, c-d at 2; the two pairs are on average 6 apart
    d = np.array([[0, 1, 5, 7], [1, 0, 5, 7], [5, 5, 0, 2], [7, 7, 2, 0]], float)
    got = linkage.average_linkage(d, [0.5, 1.5, 3, 6.5])
    assert got[0.5].tolist() == [0, 1, 2, 3] and got[1.5].tolist() == [0, 0, 1, 2]
    assert got[3].tolist() == [0, 0, 1, 1] and got[6.5].tolist() == [0, 0, 0, 0]


def test_cycle_is_contracted(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), (None, "c")], "a string, b string")
    assert {r.node: r.component for r in graphs.contract(edges).collect()} == {"a": "a", "b": "a", "c": "c"}


def test_diamond_ties(spark):
    is_a = spark.createDataFrame([("x", "p"), ("x", "q"), ("p", "top"), ("q", "top")], "child string, parent string")
    closure = graphs.ancestors(is_a)
    near = graphs.nearest_in(closure, spark.createDataFrame([("p",), ("q",)], "ancestor string"))
    assert near.where("term = 'x'").first().asDict() == {"term": "x", "nearest": "p", "steps": 1, "tie": True}


def test_rescale_is_affine_invariant(spark):
    rows = [("c", lab, "m", 100, u, u - 0.1, u, u + 0.1) for lab, u in (("a", 0.2), ("b", 0.5), ("d", 0.9))]
    schema_ = "cohort string, label string, marker string, n long, mean_u double, q10 double, q50 double, q90 double"
    one = {r.label: r.p for r in alignment.rescale(spark.createDataFrame(rows, schema_)).collect()}
    moved = [(*r[:4], *(2 * x + 1 for x in r[4:])) for r in rows]
    two = {r.label: r.p for r in alignment.rescale(spark.createDataFrame(moved, schema_)).collect()}
    assert one == pytest.approx(two)


def test_checked_join_raises(spark):
    twice = spark.createDataFrame([("a", 1), ("a", 2)], "k string, v int")
    with pytest.raises(ValueError, match="not unique"):
        schema.assert_unique(twice, ["k"])
    with pytest.raises(ValueError, match="exist"):
        schema.no_clash(twice, ["V"])
    with pytest.raises(ValueError, match="missing"):
        schema.require(twice, ["k", "nope"])


def test_column_rules():
    names = ["id", "m_a", "m_b", "m_c", "z"]
    assert schema.resolve_columns(names, pattern="^m_", exclude=["m_b"]) == ["m_a", "m_c"]
    assert schema.resolve_columns(names, between=("m_a", "m_c")) == ["m_a", "m_b", "m_c"]
    with pytest.raises(ValueError):
        schema.resolve_columns(names, between=("m_c", "m_a"))
    with pytest.raises(ValueError):
        schema.resolve_columns(names, names=["q"])


def test_dense_ids_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(3,), (None,), (1,), (3,), (2,)], "k int")
    got = sorted((r.code, r.k) for r in schema.dense_ids(df, "k", "code").collect())
    assert [c for c, _ in got] == [0, 1, 2, 3, 4] and [k for _, k in got] == [None, 1, 2, 3, 3]


def test_missing_values(spark):
    df = spark.createDataFrame([(1.0, "a|1"), (float("nan"), " NaN "), (float("inf"), "a|-1"), (None, None)], "x double, p string")
    rows = df.select(finite(df.x).alias("x"), no_patient(df.p).alias("p")).collect()
    assert [r.x for r in rows] == [1.0, None, None, None] and [r.p for r in rows] == [False, True, True, True]


def test_label_spelling(spark):
    df = spark.createDataFrame([(" Stem-like__CRYPT\t",), ("a - b",), ("",), (None,)], "x string")
    assert [r[0] for r in df.select(standard_label(df.x)).collect()] == ["stem like crypt", "a b", "", None]


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(500).selectExpr("id as cell_id", "id % 3 as load_id", "double(id) as x_px", "if(id < 400, 'hot', 'cold') as g", "string(id % 7) as s")
    def drawn(parts):
        return sorted(r.cell_id for r in sampling.round_robin(df.repartition(parts), "g", ["s"], 30).collect())

    assert drawn(1) == drawn(9) and len(drawn(3)) == 60


def test_patience(spark):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate([3.0, 2.0, 2.5, 2.4, 1.0])], "g string, i int, x double")
    assert [r.i for r in series.patience(df, "g", "i", "x", 2).collect()] == [3]


def test_gates_and_guards(spark):
    observed = spark.createDataFrame([(3, None)], "a int, b double")
    got = {r.check: r.outcome for r in gates.evaluate(observed, [("a", ">=", 3, True), ("b", "<", 1, False)]).collect()}
    assert got == {"a": "PASS", "b": "UNDECIDED"}
    x = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert gates.differences(x, x).count() == 0
    assert [tuple(r) for r in gates.differences(x, x.distinct()).collect()] == [(1, 1, "first")]
    assert gates.markdown(spark.createDataFrame([(1.5, None, "a|b")], "x double, y string, z string")).splitlines()[2] == "| 1.5000 |  | a\\|b |"
