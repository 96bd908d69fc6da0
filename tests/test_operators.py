"""Operators by hand-worked cases and brute force, beside the SQL of the queries."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessella.functions import names
from tessella.operators import graphs, ranks, schema, summaries
from tessella.plans import materialize
from tessella.plans.joins import skew_join
from tessella.queries import collect
from tessella.sources import files

QUERIES = collect()[0]


@pytest.mark.parametrize("spread", [1e-9, 0.01, 1e6])
def test_ranks_of_crowded_values(spark, spread):
    r = np.random.default_rng(1)
    values = np.round(1000 + spread * r.random(20_000), 12)
    counts = spark.createDataFrame([("g", float(v)) for v in values] + [("h", 3.0)] * 3, "g string, v double").groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    buckets = ranks.bucketed(counts.where("g = 'g'"), ["g"], "v").groupBy("_b").agg(F.count(F.lit(1)).alias("k"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("_b").collect()
    assert len(buckets) > 100 and max(b.k for b in buckets) < 1000 and all(a.hi < b.lo for a, b in zip(buckets, buckets[1:]))
    u = {x.v: x.u for x in ranks.mid_rank(counts, ["g"]).where("g = 'g'").collect()}
    order = np.sort(values)
    for v in values[:200]:
        lo, hi = np.searchsorted(order, v, "left"), np.searchsorted(order, v, "right")
        assert u[float(v)] == pytest.approx((lo + (hi - lo + 1) / 2) / len(values))
    q = {x.g: x for x in ranks.quantiles(counts, ["g"], [0.0, 0.1, 0.5, 0.99, 1.0]).collect()}
    assert q["g"].q == pytest.approx(list(np.quantile(values, [0.0, 0.1, 0.5, 0.99, 1.0])), rel=1e-15) and q["g"].rows == 20_000
    assert q["h"].q == [3.0] * 5 and ranks.quantiles(counts.limit(0), ["g"], [0.5]).count() == 0


def test_forms_of_names(spark):
    cases = {"CD45RA": ("CD45", "RA", "none"), "CD45-RO": ("CD45", "RO", "none"), "pSTAT3": ("STAT3", "pan", "phospho"), "Phospho-AKT": ("AKT", "pan", "phospho"), "H3K9ac": ("H3", "K9ac", "none"), "HH3 K27me3": ("H3", "K27me3", "none"),
             "S6": ("RPS6", "pan", "none"), "p53": ("p53", "pan", "none"), "NA": ("NA", "pan", "none"), "": ("", "pan", "none"), "CD8": ("CD8", "pan", "none")}
    df = spark.createDataFrame([(c,) for c in cases], "name string").select("name", names.form(F.col("name")).alias("f"))
    assert {r.name: tuple(r.f) for r in df.collect()} == cases
    bare = {"CD8 - x:Cyc_3_ch_2": "CD8", "CD8_Cyc_3_ch_2": "CD8", " CD8\t-\tx ": "CD8", "CD8:x - y": "CD8", "CD-8": "CD-8", "": ""}
    got = spark.createDataFrame([(c,) for c in bare], "name string").select("name", names.bare(F.col("name")).alias("b")).collect()
    assert {r.name: r.b for r in got} == bare


def test_positions_of_texts(spark):
    texts = sorted({f"{p}{k:03d}{s}" for p in ("", "Ä", "zz", "shared prefix ") for k in range(40) for s in ("", "é")}, key=lambda t: t.encode())
    rows = schema.dense_ids(spark.createDataFrame([(t,) for t in reversed(texts)], "t string").repartition(5), "t", "i").collect()
    assert {r.t: r.i for r in rows} == {t: i for i, t in enumerate(texts)}


def test_manifest_states(spark):
    was = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, "c", 3), (4, "d", 4)], "k int, digest string, n_bytes long")
    now = spark.createDataFrame([(1, "a", 1), (2, "x", 2), (3, "c", 9), (5, "e", 5)], "k int, digest string, n_bytes long")
    assert {r.k: r.state for r in files.verify(files.stored_manifest(was), now, "k").collect()} == {1: "same", 2: "digest", 3: "size", 4: "missing", 5: "new"}


def test_list_without_header(spark):
    odd = ["NA", " lead", 'q"uote', "comma,x", "ü"]
    assert {r.m for r in files.list_round_trip(spark.createDataFrame([(x,) for x in odd], "x string"), "m").collect()} == set(odd)


def test_compute_or_load(spark, tmp_path):
    calls, source = [], str(tmp_path / "in")
    spark.range(3).write.parquet(source)

    def make():
        calls.append(1)
        return spark.read.parquet(source)

    get = lambda: materialize.compute_or_load(spark, "t", [source], make).count()
    assert [get(), get()] == [3, 3] and len(calls) == 1
    spark.range(5).write.mode("append").parquet(source)
    assert get() == 8 and len(calls) == 2
    materialize.forget()
    assert get() == 8 and len(calls) == 3


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("Context", (), {"master": "spark://somewhere:7077"})()  # noqa: N815

    with pytest.raises(ValueError):
        materialize.shared_dir(Session())


def test_interval_of_a_mean(spark):
    x = [3.0, 5.0, 4.0, 9.0, 1.0, 6.0]
    r = summaries.t_interval(spark.createDataFrame([("a", v) for v in x] + [("b", 1.0)], "g string, x double"), ["g"], "x").orderBy("g").collect()
    half = 2.570582 * np.std(x, ddof=1) / np.sqrt(6)
    assert (r[0].low, r[0].high) == pytest.approx((np.mean(x) - half, np.mean(x) + half), abs=2e-3) and r[1].low is None
    bars = [b[0] for b in spark.createDataFrame([(4.0,), (10.0,), (30.0,), (1e9,)], "d double").select(summaries.t_bar(F.col("d"))).collect()]
    assert bars == pytest.approx([2.776445, 2.228139, 2.042272, 1.959964], abs=1e-3)


def test_endless_ancestors_are_an_error(spark):
    with pytest.raises(ValueError):
        graphs.ancestors(spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string"), depth=5)


def test_checksums(spark, tiny):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{tiny}/documents.parquet", columns=["doc_id", "text"]).to_pylist() if r["text"] is not None}
    got = {r.doc_id: (r.crc, r.n_bytes) for r in QUERIES["crc_manifest"](spark, tiny).collect()}
    assert got == {k: (zlib.crc32(t.encode()), len(t.encode())) for k, t in texts.items()}


@pytest.mark.parametrize("rows", [0, 100])
def test_skewed_join(spark, rows):
    big = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'hot', string(id % 50)) as k")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("7", 3)], "k string, v int")
    got = sorted((r.id, r.v) for r in skew_join(big, small, ["k"], F.col("id"), rows=rows).collect())
    assert got == sorted((r.id, r.v) for r in big.join(small, "k").collect())
    left = skew_join(big, small, ["k"], F.col("id"), "left", rows=rows)
    assert left.count() == big.join(small, "k", "left").count()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeats_are_not_broadcast(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 as k").write.parquet(f"{tmp_path}/big")
    spark.range(7).selectExpr("id as k", "143L as n", "id * 2 as v").write.parquet(f"{tmp_path}/small")
    big, small = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("big", "small"))
    for hits in (None, "n"):  # the planner takes the repeats for no more than the file
        joined = skew_join(big, small, ["k"], F.col("id"), rows=6, hits=hits)
        assert "BroadcastHashJoin" not in plan_of(joined) and joined.count() == 1000
    assert "BroadcastHashJoin" in plan_of(skew_join(big, small, ["k"], F.col("id"), rows=7))
    assert "BroadcastHashJoin" not in plan_of(big.join(materialize.broadcast_up_to(small, 6), "k"))
    assert "BroadcastHashJoin" in plan_of(big.join(materialize.broadcast_up_to(small, 7), "k"))


def test_wide_rows_are_not_broadcast(spark, tmp_path):
    spark.range(100).selectExpr("id as k", "repeat('x', 400000) as name").write.parquet(f"{tmp_path}/wide")
    wide, big = spark.read.parquet(f"{tmp_path}/wide"), spark.range(1000).selectExpr("id % 100 as k")
    assert not materialize.fits(wide, 100) and materialize.fits(wide, 100, 41) and materialize.fits(wide.select("k"), 100) and not materialize.fits(wide.select("k"), 99)
    assert "BroadcastHashJoin" not in plan_of(skew_join(big, wide, ["k"], F.col("k")))
    assert "BroadcastHashJoin" not in plan_of(big.join(materialize.broadcast_up_to(wide), "k"))
    assert materialize.fits(spark.createDataFrame([(None, None)], "s string, a array<double>"), 1) and materialize.fits(wide.limit(0), 0)


def test_only_hot_keys_are_repeated(spark):
    values = [(i, "g", 0.0 if i % 2 else -0.0) for i in range(3000)] + [(3000 + i, "g", float(i + 1)) for i in range(3000)]
    big = spark.createDataFrame(values, "id long, k string, v double")
    small = big.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    joined = skew_join(big, small, ["k", "v"], F.col("id"), rows=0, hits="n")
    assert joined.columns == ["k", "v", "id", "top"]
    got = {r.id: r.top for r in joined.collect()}
    assert joined.count() == 6000 and all(got[i] == (2999 if i < 3000 else i) for i in range(6000))
    assert skew_join(big, small.limit(0), ["k", "v"], F.col("id"), rows=-1, hits="n").count() == 0


def test_ranks_of_many_values_reach_their_rows(spark, tmp_path):
    n = 101_000
    none = [f"cast(null as double) as {c}" for c in ("label_confidence", "raw_dnx", "raw_velk2", "raw_orsa1", "raw_tamq4")]
    cells = spark.range(n).selectExpr("id as cell_id", "'A' as cohort", "'s' as image_id", "'p' as patient_id", "0D as x_px", "0D as y_px", "'t' as native_label", "1L as load_id", "double(if(id < 500, 0, id)) as area_px2", *none)
    cells.write.parquet(f"{tmp_path}/cells.parquet")
    got = QUERIES["ecdf_cohort"](spark, str(tmp_path))
    assert "BroadcastHashJoin" not in plan_of(got)  # 100,501 values: more than the driver is to hold
    wrong = got.where(F.abs(F.col("u") - F.when(F.col("cell_id") < 500, 250.5).otherwise(F.col("cell_id") + 1) / n) > 1e-8)
    assert got.count() == n and wrong.count() == 0
