"""Problem 3: column profiles per load, broken values, and distribution changes between loads.

Changes are found by a classifier two-sample test.  Rows are reduced to counts per load, fold and value bin, which are
sufficient statistics of logistic regressions on bins; the regressions of all loads are then trained together, each
Newton step being sums that Spark takes over these counts.  Cross-fitted scores tell how well a load can be told from
its baseline, and leaving a column out tells how much of that is due to it.  The classifier chooses the columns whose
distributions are then compared exactly.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.cells import finite, no_patient, null_number
from tessella.plans.materialize import broadcast_up_to, cut

NUMERIC = ("area_px2", "label_confidence")
COLUMNS = (*NUMERIC, "patient_id")
#: Bins of a column; COARSE of them make one bin of the grid of all columns.
FINE, COARSE = 128, 8
MISSING, ODD = -1, -2
#: Fixed value: the two-sample distance that equal distributions exceed once in twenty times, by the root of 1/n + 1/m.
CHANCE = 1.36


def _in_range(name: str) -> Column:
    x = F.col(name)
    return (x > 0) & (x <= 5000) if name == "area_px2" else (x >= 0) & (x <= 1)


def _binned(rows: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """``rows`` with ``bin_c`` for each column c of ``edges``: the number of its edges below the value; MISSING for NULL
    and NaN, ODD for infinite numbers.  A binary search in seven steps over the edges as an array."""
    inf = float("inf")
    places = {c: F.array(*[F.lit(float(e)) for e in (at + [inf] * FINE)[: FINE - 1]]) for c, at in edges.items()}
    rows = rows.withColumns({f"bin_{c}": F.lit(0) for c in edges})
    step = FINE // 2
    while step:
        at = {c: F.col(f"bin_{c}") for c in edges}
        rows = rows.withColumns({f"bin_{c}": at[c] + F.when(F.col(c) > F.element_at(places[c], at[c] + step), step).otherwise(0) for c in edges})
        step //= 2
    odd = {c: F.when(null_number(F.col(c)), MISSING).when(F.abs(c) == inf, ODD).otherwise(F.col(f"bin_{c}")) for c in edges}
    return rows.withColumns({f"bin_{c}": x for c, x in odd.items()})


def edges_of(rows: DataFrame, columns=NUMERIC) -> dict[str, list[float]]:
    """At most FINE - 1 quantiles of each column's finite values over all loads."""
    levels = [i / FINE for i in range(1, FINE)]
    got = rows.agg(*[F.percentile_approx(finite(F.col(c)), levels, 2_000).alias(c) for c in columns]).first()
    return {c: sorted(set(got[c] or [])) for c in columns}


def profile_columns(rows: DataFrame, by: str = "load_id") -> DataFrame:
    """Rows, nulls, distinct values and range of every column but ``by``, for each value of ``by``.

    NULL and NaN are null; infinite values count.  ``min_value`` and ``max_value`` are given for numbers and
    timestamps (in seconds), ``min_text`` and ``max_text`` for strings.  Distinct values are told apart by a 64-bit
    hash.  Rows with a NULL ``by`` form a load of their own; an empty table gives no rows.
    """
    fields = [f for f in rows.schema if f.name != by]

    def null(f: T.StructField) -> Column:
        c = F.col(f.name)
        return null_number(c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else c.isNull()

    def value(f: T.StructField) -> Column:
        return F.when(~null(f), F.col(f.name))

    def number(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(value(f).cast("timestamp")) / 1e6
        return value(f).cast("double") if isinstance(f.dataType, T.NumericType) else F.lit(None).cast("double")

    def text(f: T.StructField) -> Column:
        return value(f) if isinstance(f.dataType, T.StringType) else F.lit(None).cast("string")

    aggregates = [F.count(F.lit(1)).alias("n_rows")]
    for i, f in enumerate(fields):
        aggregates += [
            F.count_if(null(f)).alias(f"nulls{i}"), F.min(number(f)).alias(f"low{i}"), F.max(number(f)).alias(f"high{i}"),
            F.min(text(f)).alias(f"first{i}"), F.max(text(f)).alias(f"last{i}"),
        ]
    wide = rows.groupBy(by).agg(*aggregates)
    one = [
        F.struct(
            F.lit(f.name).alias("column_name"), F.col(f"nulls{i}").alias("n_null"), F.col(f"low{i}").alias("min_value"),
            F.col(f"high{i}").alias("max_value"), F.col(f"first{i}").alias("min_text"), F.col(f"last{i}").alias("max_text"),
        )
        for i, f in enumerate(fields)
    ]
    base = wide.select(by, "n_rows", F.inline(F.array(*one)))
    hashes = [F.struct(F.lit(f.name).alias("column_name"), F.when(~null(f), F.xxhash64(f.name)).alias("h")) for f in fields]
    seen = rows.select(by, F.inline(F.array(*hashes))).where("h is not null").distinct()
    distinct = seen.groupBy(F.col(by).alias("_by"), F.col("column_name").alias("_name")).agg(F.count(F.lit(1)).alias("n_distinct"))
    return (
        base.join(distinct, F.col(by).eqNullSafe(F.col("_by")) & (F.col("column_name") == F.col("_name")), "left")
        .select(
            by, "column_name", "n_rows", "n_null", (F.col("n_null") / F.col("n_rows")).alias("null_rate"),
            F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "min_value", "max_value", "min_text", "max_text",
        )
    )


def bin_counts(cells: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """All that a load's checks need of its rows, in one pass: rows, least and greatest finite value and values out of range
    for each load, fold, column and bin; for ``patient_id`` for each of its values, as ``text``."""
    rows = cells.where("load_id is not null").select("load_id", "patient_id", _fold(), *[F.col(c).cast("double").alias(c) for c in edges])
    one = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"bin_{c}").alias("bin"), F.when(F.col(f"bin_{c}") >= 0, F.col(c)).alias("value"),
            ((F.col(f"bin_{c}") != MISSING) & ~_in_range(c)).alias("outside"), F.lit(None).cast("string").alias("text"),
        )
        for c in edges
    ]
    ids = F.struct(F.lit("patient_id").alias("column_name"), F.lit(0).alias("bin"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("outside"), F.col("patient_id").alias("text"))
    return (
        _binned(rows, edges).select("load_id", "fold", F.inline(F.array(*one, ids))).groupBy("load_id", "fold", "column_name", "bin", "text")
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_if("outside").alias("n_outside"))
    )


def _fold() -> Column:
    return F.pmod(F.xxhash64("cell_id", "x_px"), F.lit(2)).cast("int").alias("fold")


def _judged(ids: DataFrame, cohorts: DataFrame) -> DataFrame:
    """``ids`` (patient ids as ``text``) with ``bin``: MISSING for no patient, ODD for an id that doesn't have the form
    of the cohort it names, else 0."""
    forms = broadcast_up_to(cohorts.select(F.col("cohort").alias("_named"), "patient_pattern").where("_named is not null").dropDuplicates(["_named"]))
    whole = F.regexp("text", F.concat(F.lit(r"\A(?:"), "patient_pattern", F.lit(r")\z")))
    kind = F.when(no_patient(F.col("text")), MISSING).when(F.coalesce(whole, F.lit(False)), 0).otherwise(ODD)
    return ids.join(forms, F.substring_index("text", "|", 1) == F.col("_named"), "left").withColumn("bin", kind).drop("_named", "patient_pattern")


def _exceeds(part: Column, of: Column, other: Column, other_of: Column, limit: float) -> Column:
    """Whether two shares differ by more than ``limit``, in whole numbers so that a difference of just that is none."""
    share = Fraction(limit).limit_denominator(10_000)
    a, n, b, m = (c.cast("decimal(19,0)") for c in (part, of, other, other_of))
    return F.abs(a * m - b * n) * share.denominator > n * m * share.numerator


def _pairs(loads: DataFrame) -> DataFrame:
    return loads.where("load_id is not null and baseline_load_id is not null").select("load_id", F.col("baseline_load_id").alias("baseline")).distinct()


def _sides(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts per load as counts per pair: ``ours`` and ``theirs``."""
    nothing = F.lit(0).cast("long")
    ours = counts.join(pairs, "load_id").withColumns({"pair": F.col("load_id"), "ours": F.col("n"), "theirs": nothing})
    theirs = counts.withColumnRenamed("load_id", "baseline").join(pairs.withColumnRenamed("load_id", "pair"), "baseline").withColumns({"ours": nothing, "theirs": F.col("n")})
    return ours.drop("load_id", "baseline", "n").unionByName(theirs.drop("baseline", "n"))


def _folds(sides: DataFrame, *keys: str) -> DataFrame:
    """Two models for each pair: model 0 learns from fold 1 (``ours``, ``theirs``) and is tried on fold 0 (``ours_tried``,
    ``theirs_tried``), model 1 the other way round."""
    def n(side: str, fold: Column | int) -> Column:
        return F.sum(F.when(F.col("fold") == fold, F.col(side)).otherwise(0))

    cells = [F.struct(F.lit(m).alias("model"), n("ours", 1 - m).alias("ours"), n("theirs", 1 - m).alias("theirs"), n("ours", m).alias("ours_tried"), n("theirs", m).alias("theirs_tried")) for m in (0, 1)]
    return sides.groupBy("pair", *keys).agg(F.array(*cells).alias("models")).select("pair", *keys, F.inline("models"))


def _logit(score: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), score))))


def _weighted(rows: DataFrame, one: WindowSpec) -> DataFrame:
    """Weights of both loads' rows, so that a large load doesn't set the threshold."""
    n1, n0 = F.sum("ours").over(one), F.sum("theirs").over(one)
    hit = F.when(n1 > 0, F.col("ours") * (n1 + n0) / (2 * n1)).otherwise(0.0)
    miss = F.when(n0 > 0, F.col("theirs") * (n1 + n0) / (2 * n0)).otherwise(0.0)
    return rows.withColumns({"_hit": hit, "_all": hit + miss})


def column_scores(bins: DataFrame, ridge: float = 10.0, steps: int = 4) -> DataFrame:
    """``bins`` (as from ``_folds``, by column and bin) with ``score``: the logistic regressions of all pairs, columns and
    models at once, on a value's rank and on its bin, whose own effect a ridge holds back until rows bear it out.

    A step of Newton's method needs five sums of each regression, over the bins of rows; the bins' own effects then
    follow from the common ones (the Hessian is diagonal in them).
    """
    one = Window.partitionBy("pair", "column_name", "model")
    rank = F.when(F.col("bin") >= 0, F.col("bin") / FINE - 0.5).otherwise(0.0)
    rows = _weighted(bins.withColumn("_r", rank), one).withColumns({"_a": F.lit(0.0), "_b": F.lit(0.0), "_d": F.lit(0.0)})
    p, r, every = F.col("_p"), F.col("_r"), F.col("_all")
    g, h, own = F.col("_hit") - p * every, F.greatest(p * (1 - p) * every, F.lit(1e-9)), F.col("_d") * ridge
    q, e = h * ridge / (h + ridge), g - h * (g - own) / (h + ridge)
    for _ in range(steps):
        rows = rows.withColumn("_p", _logit(F.col("_a") + F.col("_b") * r + F.col("_d")))
        rows = rows.withColumns({f"_s{i}": F.sum(x).over(one) for i, x in enumerate((q, q * r, q * r * r, e, e * r))})
        s = [F.col(f"_s{i}") + (1e-3 if i in (0, 2) else 0.0) for i in range(5)]
        det = s[0] * s[2] - s[1] * s[1]
        near = [F.greatest(F.lit(-4.0), F.least(F.lit(4.0), x / det)) for x in (s[2] * s[3] - s[1] * s[4], s[0] * s[4] - s[1] * s[3])]
        rows = rows.withColumns({"_da": near[0], "_db": near[1]})
        rows = rows.withColumns({"_a": F.col("_a") + F.col("_da"), "_b": F.col("_b") + F.col("_db"), "_d": F.col("_d") + (g - own - h * (F.col("_da") + F.col("_db") * r)) / (h + ridge)})
    return rows.select(*bins.columns, (F.col("_b") * r + F.col("_d")).alias("score"))


def _discrimination(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``auc`` and ``gap`` of each model's scores on the fold it hasn't learned from: the area under the curve, and the
    greatest difference of the two loads' distributions over the score, this for finite values (``bin`` not below 0) only."""
    sides = {"_x1": ("ours_tried", F.lit(True)), "_x0": ("theirs_tried", F.lit(True)), "_y1": ("ours_tried", F.col("bin") >= 0), "_y0": ("theirs_tried", F.col("bin") >= 0)}
    tied = rows.groupBy(*keys, F.round("score", 9).alias("score")).agg(*[F.sum(F.when(where, F.col(side)).otherwise(0)).alias(k) for k, (side, where) in sides.items()])
    one = Window.partitionBy(*keys)
    upto = one.orderBy("score")
    tied = tied.withColumns({k: F.try_divide(F.col(k), F.sum(k).over(one)) for k in sides})
    tied = tied.withColumns({"_below": F.sum("_x0").over(upto) - F.col("_x0") / 2, "_apart": F.abs(F.sum("_y1").over(upto) - F.sum("_y0").over(upto))})
    return tied.groupBy(*keys).agg(F.coalesce(F.sum(F.col("_x1") * F.col("_below")), F.lit(0.5)).alias("auc"), F.coalesce(F.max("_apart"), F.lit(0.0)).alias("gap"))


def discriminate(scored: DataFrame) -> DataFrame:
    """What each column alone discriminates: cross-fitted ``auc_alone`` and ``gap_alone`` (the greater of both models')."""
    got = _discrimination(scored, ["pair", "column_name", "model"])
    return got.groupBy("pair", "column_name").agg(F.avg("auc").alias("auc_alone"), F.max("gap").alias("gap_alone"))


def ablate(cells: DataFrame, pairs: DataFrame, patients: DataFrame, edges: dict[str, list[float]], scored: DataFrame, steps: int = 5) -> DataFrame:
    """``auc`` by all columns and ``auc_lost`` without each, both cross-fitted, for each pair and column.

    The columns' scores, coarser by COARSE bins, are the features of a regression of each pair, model and set of columns.
    Rows are counts per cell of a grid of coarse bins; a step needs two sums of each slope over them, and is damped by
    the number of slopes, so that it never leads away.
    """
    names = list(COLUMNS)
    coarse = {c: F.when(F.col(f"bin_{c}") < 0, F.col(f"bin_{c}")).otherwise(F.floor(F.col(f"bin_{c}") / COARSE)).cast("int") for c in NUMERIC}
    rows = cells.where("load_id is not null").select("load_id", F.col("patient_id").alias("text"), _fold(), *[F.col(c).cast("double").alias(c) for c in NUMERIC])
    counts = _binned(rows, edges).select("load_id", "text", "fold", *[x.alias(f"c_{c}") for c, x in coarse.items()]).groupBy("load_id", "text", "fold", *[f"c_{c}" for c in NUMERIC]).agg(F.count(F.lit(1)).alias("n"))
    known = patients.groupBy(F.col("text").alias("_text")).agg(F.max("bin").alias("c_patient_id"))
    grid = (
        counts.join(broadcast_up_to(known, 100_000), F.col("text").eqNullSafe(F.col("_text")), "left")
        .groupBy("load_id", "fold", *[f"c_{c}" for c in names]).agg(F.sum("n").alias("n"))
    )
    joint = _folds(_sides(cut(grid, "grid"), pairs), *[f"c_{c}" for c in names])
    part = F.when(F.col("column_name") == "patient_id", F.col("bin")).when(F.col("bin") < 0, F.col("bin")).otherwise(F.floor(F.col("bin") / COARSE)).cast("int")
    weight = F.col("ours") + F.col("theirs") + 1e-6
    average = cut(scored.groupBy("pair", "model", "column_name", part.alias("part")).agg((F.sum(F.col("score") * weight) / F.sum(weight)).alias("s")), "scores")
    for c in names:
        side = average.where(F.col("column_name") == c).select("pair", "model", F.col("part").alias(f"c_{c}"), F.col("s").alias(f"s_{c}"))
        joint = joint.join(side, ["pair", "model", f"c_{c}"], "left").withColumn(f"s_{c}", F.coalesce(f"s_{c}", F.lit(0.0)))
    joint = joint.withColumn("without", F.explode(F.array(F.lit(""), *map(F.lit, names))))
    one = Window.partitionBy("pair", "model", "without")
    used = {f"x_{c}": F.when(F.col("without") == c, 0.0).otherwise(F.col(f"s_{c}")) for c in names}
    rows = _weighted(joint.withColumns(used), one).withColumns({"_k": F.lit(0.0), **{f"_k_{c}": F.lit(1.0) for c in names}})

    def score() -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"_k_{c}") * F.col(f"x_{c}") for c in names])

    for _ in range(steps):
        rows = rows.withColumn("_p", _logit(F.col("_k") + score()))
        g, h = F.col("_hit") - F.col("_p") * F.col("_all"), F.col("_p") * (1 - F.col("_p")) * F.col("_all")
        slopes = {"_k": F.lit(1.0), **{f"_k_{c}": F.col(f"x_{c}") for c in names}}
        rows = rows.withColumns({k: F.col(k) + F.sum(g * x).over(one) / ((F.sum(h * x * x).over(one) + 1.0) * len(slopes)) for k, x in slopes.items()})
    tried = rows.select("pair", "model", "without", "ours_tried", "theirs_tried", score().alias("score"), F.lit(0).alias("bin"))
    got = _discrimination(tried, ["pair", "model", "without"]).groupBy("pair", "without").agg(F.avg("auc").alias("auc"))
    full = got.where("without = ''").select("pair", "auc")
    return got.where("without <> ''").select("pair", F.col("without").alias("column_name"), F.col("auc").alias("_less")).join(full, "pair").select(
        "pair", "column_name", "auc", (F.col("auc") - F.col("_less")).alias("auc_lost")
    )


class LoadComparison:
    """Loads and their baselines: one pass over the rows for bins, another for the values of the bins that need it."""

    def __init__(self, cells: DataFrame, loads: DataFrame, cohorts: DataFrame):
        self.cells = cells.select("load_id", "cell_id", "x_px", *COLUMNS)
        self.pairs = broadcast_up_to(_pairs(loads))
        self.edges = edges_of(cells)
        self.counts = cut(bin_counts(self.cells, self.edges), "bins")
        ids = self.counts.where("column_name = 'patient_id'").select("load_id", "fold", "text", "n")
        self.patients = cut(_judged(ids, cohorts), "patients")

    def base(self) -> DataFrame:
        """Rows, nulls and values out of range per load and column: the exact aggregates."""
        numbers = self.counts.where("column_name <> 'patient_id'").select("load_id", "column_name", "n", F.when(F.col("bin") == MISSING, F.col("n")).otherwise(0).alias("nulls"), "n_outside")
        ids = self.patients.select("load_id", F.lit("patient_id").alias("column_name"), "n", F.when(F.col("bin") == MISSING, F.col("n")).otherwise(0).alias("nulls"), F.when(F.col("bin") == ODD, F.col("n")).otherwise(0).alias("n_outside"))
        return numbers.unionByName(ids).groupBy("load_id", "column_name").agg(F.sum("n").alias("n_rows"), F.sum("nulls").alias("n_null"), F.sum("n_outside").alias("n_broken"))

    def scored(self) -> DataFrame:
        """The columns' regressions: one row for each pair, column, model and bin."""
        numbers = self.counts.where("column_name <> 'patient_id'").select("load_id", "fold", "column_name", "bin", "n")
        ids = self.patients.select("load_id", "fold", F.lit("patient_id").alias("column_name"), "bin", "n")
        return cut(column_scores(_folds(_sides(numbers.unionByName(ids), self.pairs), "column_name", "bin")), "scored")

    def _bins(self) -> DataFrame:
        """Bins of finite values of each pair and column with the shares before them, and whether they hold one value."""
        numbers = self.counts.where("column_name <> 'patient_id' and bin >= 0").groupBy("load_id", "column_name", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        bins = _sides(numbers, self.pairs).groupBy("pair", "column_name", "bin").agg(F.sum("ours").alias("ours"), F.sum("theirs").alias("theirs"), (F.min("low") == F.max("high")).alias("single"))
        column = Window.partitionBy("pair", "column_name")
        upto = column.orderBy("bin")
        return (
            bins.withColumns({"all_ours": F.sum("ours").over(column), "all_theirs": F.sum("theirs").over(column)}).where("all_ours > 0 and all_theirs > 0")
            .withColumns({"before_ours": F.sum("ours").over(upto) - F.col("ours"), "before_theirs": F.sum("theirs").over(upto) - F.col("theirs")})
        )

    def differences(self, scored: DataFrame, limit: float, least: float, exact: bool) -> DataFrame:
        """``difference`` and ``drift`` of the candidates, the columns whose cross-fitted classifier leaves a difference over
        ``least`` possible: its ``gap_alone``, with the share of the fullest bin that holds several values (there, the
        difference can be greater than between bins) and what chance allows between samples of this size, exceeds it.

        Without ``exact``, values are only counted where the bins leave ``drift`` open.
        """
        tested = discriminate(scored)
        mass = F.greatest(F.col("ours") / F.col("all_ours"), F.col("theirs") / F.col("all_theirs"))
        chance = CHANCE * F.sqrt(2 / F.col("all_ours") + 2 / F.col("all_theirs"))
        column = Window.partitionBy("pair", "column_name")
        bins = self._bins().withColumns({"mass": F.max(F.when(F.col("single"), 0.0).otherwise(mass)).over(column), "chance": chance})
        at_start = F.col("before_ours") / F.col("all_ours") - F.col("before_theirs") / F.col("all_theirs")
        reach = F.greatest(F.abs(at_start + F.col("ours") / F.col("all_ours")), F.abs(at_start - F.col("theirs") / F.col("all_theirs")))
        end_ours, end_theirs = F.col("before_ours") + F.col("ours"), F.col("before_theirs") + F.col("theirs")
        at_end = F.abs(end_ours / F.col("all_ours") - end_theirs / F.col("all_theirs"))
        over = _exceeds(end_ours, F.col("all_ours"), end_theirs, F.col("all_theirs"), limit)
        open_ = cut(
            bins.join(tested, ["pair", "column_name"]).where(F.col("gap_alone") + F.col("mass") + F.col("chance") > least)
            .withColumns({"reach": reach, "known": F.max(at_end).over(column), "over": F.max(over).over(column)}),
            "open",
        )
        # only bins that can hold a greater difference than the one known at the bins' ends are counted value by value
        asked = open_.where(~F.col("single") & (F.col("reach") > F.col("known") - 1e-9))
        if not exact:
            asked = asked.where(~F.col("over") & (F.col("reach") > limit - 1e-9))
        involved = asked.select("pair", "column_name", "bin").join(self.pairs.withColumnRenamed("load_id", "pair"), "pair")
        sides = [involved.select(F.col(side).alias("load_id"), "column_name", "bin") for side in ("pair", "baseline")]
        needed = broadcast_up_to(cut(sides[0].unionByName(sides[1]).distinct(), "needed"), 100_000)
        values = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"), F.col(f"bin_{c}").alias("bin")) for c in NUMERIC]
        rows = self.cells.where("load_id is not null").select("load_id", *[F.col(c).cast("double").alias(c) for c in NUMERIC])
        long = _binned(rows, self.edges).select("load_id", F.inline(F.array(*values))).where("bin >= 0")
        counts = long.join(needed, ["load_id", "column_name", "bin"], "left_semi").groupBy("load_id", "column_name", "bin", "value").agg(F.count(F.lit(1)).alias("n"))
        points = _sides(counts, self.pairs).groupBy("pair", "column_name", "bin", "value").agg(F.sum("ours").alias("ours"), F.sum("theirs").alias("theirs"))
        inner = Window.partitionBy("pair", "column_name", "bin").orderBy("value")
        ours, theirs = F.col("before_ours") + F.sum("ours").over(inner), F.col("before_theirs") + F.sum("theirs").over(inner)
        inside = (
            points.join(asked.drop("ours", "theirs", "over"), ["pair", "column_name", "bin"])
            .withColumns({"d": F.abs(ours / F.col("all_ours") - theirs / F.col("all_theirs")), "over": _exceeds(ours, F.col("all_ours"), theirs, F.col("all_theirs"), limit)})
            .select("pair", "column_name", "d", "over")
        )
        ends = open_.select("pair", "column_name", F.col("known").alias("d"), "over").distinct()
        return ends.unionByName(inside).groupBy("pair", "column_name").agg(F.max("d").alias("difference"), F.max("over").alias("drift"))


def distribution_changes(cells: DataFrame, loads: DataFrame, cohorts: DataFrame, limit: float = 0.2, least: float = 0.05) -> DataFrame:
    """The classifier two-sample test of each load with a baseline: one row per load and column.

    ``auc`` is the cross-fitted discrimination by all columns, ``auc_lost`` what leaving the column out costs,
    ``auc_alone`` and ``gap_alone`` what the column discriminates on its own; ``difference`` is the exact greatest
    difference of the distribution functions where the classifier leaves one over ``least`` possible, NULL elsewhere, and
    ``drift`` says whether it exceeds ``limit``.  NULL loads don't count; an empty table gives no rows.
    """
    both = LoadComparison(cells, loads, cohorts)
    scored = both.scored()
    alone = discriminate(scored).join(ablate(both.cells, both.pairs, both.patients, both.edges, scored), ["pair", "column_name"])
    found = alone.join(both.differences(scored, limit, min(least, limit), True), ["pair", "column_name"], "left")
    return found.select(F.col("pair").alias("load_id"), "column_name", "auc", "auc_lost", "auc_alone", "gap_alone", "difference", F.coalesce("drift", F.lit(False)).alias("drift"))


def load_issues(cells: DataFrame, loads: DataFrame, cohorts: DataFrame, null_limit: float = 0.05, drift_limit: float = 0.2) -> DataFrame:
    """``load_id``, ``column_name``, ``issue``: what is wrong with each load, over all its rows, repeats included.

    ``range`` and ``pattern`` need one broken value; ``null_rate`` and ``drift`` compare with the baseline load and
    need rows in both.  A NULL ``load_id`` belongs to no load; other columns aren't read; an empty table gives no rows.
    """
    both = LoadComparison(cells, loads, cohorts)
    base = cut(both.base(), "base")
    broken = base.where("n_broken > 0").select("load_id", "column_name", F.when(F.col("column_name") == "patient_id", "pattern").otherwise("range").alias("issue"))
    other = base.select(F.col("load_id").alias("baseline"), "column_name", F.col("n_null").alias("base_n"), F.col("n_rows").alias("base_rows"))
    compared = base.join(both.pairs, "load_id").join(other, ["baseline", "column_name"])
    nulls = compared.where(_exceeds(F.col("n_null"), F.col("n_rows"), F.col("base_n"), F.col("base_rows"), null_limit)).select("load_id", "column_name", F.lit("null_rate").alias("issue"))
    drift = both.differences(both.scored(), drift_limit, drift_limit, False).where("drift").select(F.col("pair").alias("load_id"), "column_name", F.lit("drift").alias("issue"))
    return broken.unionByName(nulls).unionByName(drift)
