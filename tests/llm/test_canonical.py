from __future__ import annotations

from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm.bktree import BKTree, distance
from tessella.llm.canonical import map_registry, match_values
from tessella.llm.names import bare_names, split_member

WORD = st.text(alphabet="abcd", max_size=7)


def test_distances():
    assert [distance(*p) for p in (("", "abc"), ("ca", "abc"), ("abcd", "abdc"), ("aab", "ab"), ("kitten", "sitting"))] == [3, 2, 1, 1, 3]


@given(WORD, WORD, WORD)
@settings(max_examples=300, deadline=None)
def test_metric(a, b, c):
    assert distance(a, b) == distance(b, a) and (distance(a, b) == 0) == (a == b)
    assert distance(a, c) <= distance(a, b) + distance(b, c)


@given(st.lists(WORD, max_size=30), WORD, st.integers(0, 3))
@settings(max_examples=200, deadline=None)
def test_tree_loses_nothing(words, asked, most):
    assert sorted(BKTree(words).within(asked, most)) == sorted((w, distance(w, asked)) for w in set(words) if distance(w, asked) <= most)


def test_names():
    assert bare_names("anti-YBDMC4 - killer lymphoid:Cyc_14_ch_3")[0] == "YBDMC4"
    assert "CXNRLU3" in bare_names("pCXNRLU3") and "HYJKAS3" in bare_names("153Eu_HYJKAS3(153EuDi)")
    assert bare_names("n/a") == [] == bare_names(None) == bare_names("???")
    assert ("corraloxin", "4") in split_member("corraloxin (4)") and ("kelodulin", "1") in split_member("KELODULIN I")
    assert ("helbexfendulin", "beta") in split_member("helbexfendulin_β") and ("sedric", "gamma") in split_member("γ-sedric")


REF = [
    ("GRX:00109", "RXXDKB1", "sejorflokine alpha", "DD-664|AB-1", "WT815", ""), ("GRX:00112", "RXXDKB2", "sejorflokine beta", "AB-1", "", ""),
    ("GRX:00500", "KELOD1", "kelodulin 1", "", "", ""), ("ELE:01782", "NA", "sodium", "Na23", "", ""), ("FAM:01741", "RXXDKB_PAN", "pan sejorflokine", "", "", "RXXDKB1|RXXDKB2"),
]
CASES = {
    "RXXDKB1": "GRX:00109", "rxxdkb-1 (AF488)": "GRX:00109", "RXDKB2": "GRX:00112", "RXXDBK2": "GRX:00112", "RDKB2": "", "RXXDKB7": "", "AB-1": "", "dd 664": "GRX:00109", "DD-665": "",
    "Sejorflokin β": "GRX:00112", "sejrflokin-alpha:cyc1ch2": "GRX:00109", "KELODULIN I": "GRX:00500", "NA": "ELE:01782", "n/a": "", "wt815": "GRX:00109", "grx_109": "GRX:00109", "GRX:9999": "",
    "rxxdkb1|RXXDKB2": "FAM:01741", "ＲＸＸＤＫＢ１": "GRX:00109", "KELOD​1 rep2": "GRX:00500", "  ": "", "x" * 20_000: "",
}


def test_cases(spark):
    ref = spark.createDataFrame(REF, "canon_id string, symbol string, full_name string, aliases string, prev_symbol string, members string")
    rows = [(i, text, None, "") for i, text in enumerate(CASES)]
    reg = spark.createDataFrame(rows, "registry_id long, raw_column string, gene string, resolved_id string").selectExpr("*", "'clash' as canon_id", "1 as distance")
    got = {r.registry_id: r.canon_id for r in map_registry(reg, ref).collect()}
    assert {text: got[i] for i, text in enumerate(CASES)} == CASES
    values = reg.selectExpr("raw_column as value")
    whole = sorted(tuple(r) for r in match_values(values, ref).collect())
    assert whole == sorted(tuple(r) for r in match_values(values, ref, shard_names=2, shard_queries=5).collect())


def test_nulls_and_empty(spark):
    ref = spark.createDataFrame([(None, "A1", None, None, None, None), ("GRX:00001", None, None, None, None, None)], "canon_id string, symbol string, full_name string, aliases string, prev_symbol string, members string")
    reg = spark.createDataFrame([(1, None, None, None), (1, None, None, None), (2, "A1", "", "GRX:1")], "registry_id long, raw_column string, gene string, resolved_id string")
    assert sorted((r.registry_id, r.canon_id) for r in map_registry(reg, ref).collect()) == [(1, ""), (1, ""), (2, "GRX:00001")]
    assert map_registry(reg.limit(0), ref).count() == 0
    assert {r.canon_id for r in map_registry(reg, ref.limit(0)).collect()} == {""}


def test_slips_in_short_symbols(spark):
    ref = spark.createDataFrame([("GRX:00001", "FARQ9", "", "", "", ""), ("GRX:00002", "DNX", "", "", "", ""), ("ELE:00003", "IN", "indium", "", "", ""), ("ELE:00004", "IR", "iridium", "", "", "")], "canon_id string, symbol string, full_name string, aliases string, prev_symbol string, members string")
    cases = {"FAR9": "GRX:00001", "DXN": "GRX:00002", "DNNX": "GRX:00002", "FARQ8": "", "IN": "ELE:00003", "IX": "", "XYZ": ""}
    reg = spark.createDataFrame([(i, t, None, "") for i, t in enumerate(cases)], "registry_id long, raw_column string, gene string, resolved_id string")
    got = {r.registry_id: r.canon_id for r in map_registry(reg, ref).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases
