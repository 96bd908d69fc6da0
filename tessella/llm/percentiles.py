"""Problem 5: percentiles per group by radix selection, with bounded rank error and results that can be combined.

A number becomes an integer in the same order: the sign bit of a float decides whether its other bits are flipped.
One pass over the rows counts the leading digit of these integers per load and group, and takes a further digit of every
bin that holds enough of its load's group to matter; such histograms add up across loads, days or partitions, and the
percentiles come from them alone.  There a target rank lies in exactly one digit's bin; only such bins are followed into
their next digit, until a bin holds one value.  A bin of few stored values, be it a whole group, is resolved at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.joins import skew_join
from tessella.plans.materialize import cut

PERCENTILES = (1, 5, 25, 50, 75, 95, 99)
#: Bits of a number, of its first digit (sign and exponent), of each further digit where ranks are followed, and of each
#: further digit of a load's bins, which are to be few.
BITS, FIRST, NEXT, SPLIT = 64, 12, 13, 1
#: A group of more stored bins than this is followed digit by digit; so is a bin of more stored values.
SMALL = 200_000
#: Rows summarised at once in a task.
BATCH = 250_000


def order_key(values: np.ndarray) -> np.ndarray:
    """int64 keys in the order of the finite floats given; equal floats have equal keys, so -0.0 and 0.0 do."""
    bits = values.dtype.itemsize * 8
    raw = (values + values.dtype.type(0)).view(np.int32 if bits == 32 else np.int64).astype(np.int64)
    return np.where(raw < 0, raw ^ np.int64((1 << (bits - 1)) - 1), raw)


def key_value(keys: np.ndarray, bits: int) -> np.ndarray:
    """The floats of such keys, as float64."""
    keys = np.asarray(keys, np.int64)
    raw = np.where(keys < 0, keys ^ np.int64((1 << (bits - 1)) - 1), keys)
    return raw.astype(np.int32).view(np.float32).astype(np.float64) if bits == 32 else raw.view(np.float64)


_BINS = "array<struct<shift: int, prefix: long, n: long, low: long, high: long>>"
_HIST = f"load_id long, kind string, g1 string, g2 string, field int, total long, bins {_BINS}"
_GROUP = ("kind", "g1", "g2", "field")


def _leaves(place: np.ndarray, keys: np.ndarray, error: float) -> tuple[np.ndarray, ...]:
    """Place, shift, prefix, rows, least and greatest key of the bins of each place, in order: a bin's next digit is taken
    until the bin holds one value or less than ``error`` of its place's rows.  A place with so few rows that each of
    them matters has a bin for each value."""
    order = np.lexsort((keys, place))
    place, keys = place[order], keys[order]
    limit = error * np.bincount(place)[place] if len(place) else np.empty(0)
    done = []

    def level(some: np.ndarray, shift: int) -> np.ndarray:
        """The bins of the keys chosen that need no further digit; the keys of the others."""
        at, key, most = place[some], keys[some], limit[some]
        prefix = key >> shift
        starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (prefix[1:] != prefix[:-1])]))
        sizes = np.diff(np.append(starts, len(key)))
        low, high = key[starts], key[starts + sizes - 1]
        settled = (low == high) | (sizes < most[starts]) | (shift == 0)
        k = starts[settled]
        done.append((at[k], np.full(len(k), shift), prefix[k], sizes[settled], low[settled], high[settled]))
        return some[np.repeat(~settled, sizes)]

    few = np.flatnonzero(limit <= 1)
    if len(few):
        level(few, 0)
    rest, shift = np.flatnonzero(limit > 1), BITS - FIRST
    while len(rest):
        rest, shift = level(rest, shift), max(0, shift - SPLIT)
    if not done:
        return tuple(np.empty(0, np.int64) for _ in range(6))
    out = [np.concatenate(x).astype(np.int64) for x in zip(*done)]
    order = np.lexsort((out[4], out[0]))
    return tuple(x[order] for x in out)


def _codes(column: pa.Array) -> tuple[np.ndarray, int]:
    """Small numbers for the column's values, 0 for NULL, and how many there are."""
    coded = column.dictionary_encode()
    return coded.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1, len(coded.dictionary) + 1


def _summary(table: pa.Table, groupings: dict[str, tuple[str, ...]], fields: list[str], error: float) -> Iterator[pa.RecordBatch]:
    columns = {c: table[c].combine_chunks() for c in ("load_id", *dict.fromkeys(c for g in groupings.values() for c in g))}
    coded = {c: _codes(x) for c, x in columns.items()}
    keyed = []
    for name in fields:
        values = table[name].to_numpy()
        at = np.flatnonzero(np.isfinite(values))
        keyed.append((at, order_key(values[at])))
    for kind, group in groupings.items():
        code = coded["load_id"][0]
        for c in group:
            code = code * coded[c][1] + coded[c][0]
        _, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        for f, (at, keys) in enumerate(keyed):
            place, shift, prefix, size, low, high = _leaves(inverse[at], keys, error)
            starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.empty(0, np.int64)
            n, rows = len(starts), pa.array(first[place[starts]])
            parts = [pa.array(shift.astype(np.int32)), *map(pa.array, (prefix, size, low, high))]
            bins = pa.ListArray.from_arrays(pa.array(np.append(starts, len(place)).astype(np.int32)), pa.StructArray.from_arrays(parts, ["shift", "prefix", "n", "low", "high"]))
            second = columns[group[1]].take(rows) if len(group) > 1 else pa.nulls(n, pa.string())
            yield pa.RecordBatch.from_arrays(
                [
                    columns["load_id"].take(rows), pa.array([kind] * n, pa.string()), columns[group[0]].take(rows).cast(pa.string()), second.cast(pa.string()),
                    pa.array(np.full(n, f, np.int32)), pa.array(np.add.reduceat(size, starts) if n else np.empty(0, np.int64)), bins,
                ],
                ["load_id", *_GROUP, "total", "bins"],
            )


def _summarise(groupings: dict[str, tuple[str, ...]], fields: list[str], error: float):
    """Function for mapInArrow: one row of bins for each load, group and field of the task's rows, or of BATCH of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BATCH:
                yield from _summary(pa.Table.from_batches(held), groupings, fields, error)
                held, rows = [], 0
        if rows:
            yield from _summary(pa.Table.from_batches(held), groupings, fields, error)

    return run


def _group_key() -> Column:
    """A number for each group and field; whether a part is NULL counts."""
    return F.xxhash64("kind", F.isnull("g1"), "g1", F.isnull("g2"), "g2", "field").alias("gid")


class RadixPercentiles:
    """Percentiles of several fields in several groupings of one table."""

    def __init__(self, rows: DataFrame, groupings: dict[str, tuple[str, ...]], fields: list[str], load: str = "load_id"):
        self.fields, self.groupings = fields, groupings
        columns = list(dict.fromkeys(c for g in groupings.values() for c in g))
        self.rows = rows.select(F.col(load).cast("long").alias("load_id"), *[F.col(c).cast("string").alias(c) for c in columns], *[F.col(f).cast("double").alias(f) for f in fields])

    def _partial(self, error: float) -> DataFrame:
        return self.rows.mapInArrow(_summarise(self.groupings, self.fields, error), _HIST)

    def histograms(self, error: float = 0.005) -> DataFrame:
        """Histograms per load, group and field, a row each: the results that can be stored and combined.

        Around any value, the bins of a load that hold values on both sides of it have less than ``error`` of the rows
        of the load's group, so those of all loads together have less than ``error`` of the whole group.
        """
        keys = ["load_id", *_GROUP]
        bins = self._partial(error).select(*keys, F.inline("bins")).groupBy(*keys, "shift", "prefix").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
        packed = F.sort_array(F.collect_list(F.struct("low", "shift", "prefix", "n", "high")))
        ordered = F.transform(packed, lambda b: F.struct(b["shift"].alias("shift"), b["prefix"].alias("prefix"), b["n"].alias("n"), b["low"].alias("low"), b["high"].alias("high")))
        return bins.groupBy(*keys).agg(F.sum("n").alias("total"), ordered.alias("bins"))

    @staticmethod
    def _locate(hist: DataFrame, targets: DataFrame) -> DataFrame:
        """The bin of each target; ``before`` is the weight of the group below the bins that are listed."""
        inner = Window.partitionBy("gid", "within").orderBy("prefix")
        ranged = hist.withColumn("upto", F.sum("w").over(inner)).withColumn("lower", F.col("upto") - F.col("w"))
        return ranged.join(targets, ["gid", "within"]).where("2 * rank - before > lower and 2 * rank - before <= upto").select(
            "gid", "percentile", "rank", "total", (F.col("before") + F.col("lower")).alias("before"), "prefix", "points", "low", "high"
        )

    @staticmethod
    def _binned(points: DataFrame) -> DataFrame:
        """Weight, number of points, least and greatest key of each digit's bin."""
        return points.withColumn("prefix", F.expr("shiftright(key, shift)")).groupBy("gid", "within", "prefix").agg(
            F.sum("w").alias("w"), F.count(F.lit(1)).alias("points"), F.min("key").alias("low"), F.max("key").alias("high")
        )

    def compute(self, percentiles=PERCENTILES, error: float = 0.005, histograms: DataFrame | None = None, small: int = SMALL) -> DataFrame:
        """``kind, g1, g2, field, percentile, total, value``: the values of the target ranks, each an actual value of its
        group whose rank is off by less than ``error`` times the group's finite values.

        With ``histograms``, such as loads stored, the rows aren't read, and the error is the one these were made with.
        NULL, NaN and infinite values don't count; a group without finite values gives no row; NULL is a group of its
        own; ties and repeated rows count as often as they occur.  Groups of more than ``small`` stored bins are
        spread over tasks by their digits.
        """
        # the tasks' parts of a load's histogram add up just as the loads do, so they needn't be merged by load first
        loads = cut((self._partial(error) if histograms is None else histograms).withColumn("gid", _group_key()), "load-hist")
        sizes = loads.groupBy("gid").agg(F.sum("total").alias("total"), F.sum(F.size("bins")).alias("stored"))
        large = cut(sizes.where(F.col("stored") > small), "large")
        if large.isEmpty():
            found = self._at_once(loads, percentiles)
        else:
            ids = large.select("gid")
            few, many = (skew_join(loads, ids, ["gid"], F.col("load_id"), how) for how in ("left_anti", "left_semi"))
            found = self._at_once(few, percentiles).unionByName(self._by_digits(many, large, percentiles, small))
        names = loads.select("gid", *_GROUP).distinct()
        return self._decode(found.join(names, "gid"))

    @staticmethod
    def _weighted(loads: DataFrame) -> DataFrame:
        """``gid``, ``key`` and weight ``w``: half of a bin's rows count at its least value and half at its greatest (twice
        the rows, for whole numbers); a rank is then off by at most half of the bins that it may lie in."""
        one, two = ([F.struct(F.col(c).alias("key"), (F.col("n") * w).alias("w")) for c in cs] for w, cs in ((2, ("low",)), (1, ("low", "high"))))
        ends = F.when(F.col("low") == F.col("high"), F.array(*one)).otherwise(F.array(*two))
        return loads.select("gid", F.inline("bins")).select("gid", F.inline(ends))

    @staticmethod
    def _at_once(loads: DataFrame, percentiles) -> DataFrame:
        """``gid``, ``percentile``, ``total`` and ``key``, for groups of few stored bins: one shuffle by group."""
        points = RadixPercentiles._weighted(loads).repartition("gid").groupBy("gid", "key").agg(F.sum("w").alias("w"))
        group = Window.partitionBy("gid")
        ranged = points.withColumns({"upto": F.sum("w").over(group.orderBy("key")), "both": F.sum("w").over(group)})
        upto, w, total = F.col("upto"), F.col("w"), (F.col("both") / 2).cast("long")

        def here(p):
            rank = F.greatest(F.lit(1), F.ceil(p * F.col("both") / 200.0)).cast("long")
            return (2 * rank > upto - w) & (2 * rank <= upto)

        return ranged.select("gid", F.explode(F.filter(F.array(*map(F.lit, percentiles)), here)).alias("percentile"), total.alias("total"), "key")

    @staticmethod
    def _by_digits(loads: DataFrame, sizes: DataFrame, percentiles, small: int) -> DataFrame:
        """The same for groups of many stored bins, which are followed digit by digit."""
        points = cut(RadixPercentiles._weighted(loads).groupBy("gid", "key").agg(F.sum("w").alias("w")), "points")
        shift = BITS - FIRST
        hist = RadixPercentiles._binned(points.withColumns({"shift": F.lit(shift), "within": F.lit(0).cast("long")}))
        rank = F.greatest(F.lit(1), F.ceil(F.col("percentile") * F.col("total") / 100.0)).cast("long")
        targets = (
            sizes.select("gid", "total", F.explode(F.array(*map(F.lit, percentiles))).alias("percentile")).withColumn("rank", rank)
            .withColumns({"before": F.lit(0).cast("long"), "within": F.lit(0).cast("long")})
        )
        done: list[DataFrame] = []
        while True:
            found = cut(RadixPercentiles._locate(hist, targets), "ranks")
            settled = F.col("low") == F.col("high")
            done.append(found.where(settled))
            open_ = found.where(~settled)
            if open_.isEmpty():
                break
            below = max(0, shift - NEXT)
            bins = open_.withColumn("to", F.when(F.col("points") <= small, 0).otherwise(below)).withColumnRenamed("prefix", "within")
            followed = cut(bins.select("gid", "within", F.col("to").alias("shift")).distinct(), "followed")
            inside = skew_join(points.withColumn("within", F.shiftright("key", shift)), followed, ["gid", "within"], F.col("key"))
            hist = RadixPercentiles._binned(inside)
            targets = bins.select("gid", "percentile", "rank", "total", "before", "within")
            shift = below
        return reduce(DataFrame.unionByName, done).select("gid", "percentile", "total", F.col("low").alias("key"))

    def _decode(self, out: DataFrame) -> DataFrame:
        def value(key: pd.Series) -> pd.Series:
            return pd.Series(key_value(key.to_numpy(np.int64), BITS))

        names = F.array(*map(F.lit, self.fields))
        return out.select("kind", "g1", "g2", names[F.col("field")].alias("field"), "percentile", "total", F.pandas_udf(value, T.DoubleType())("key").alias("value"))


CELL_FIELDS = ["area_px2", "raw_dnx", "raw_velk2", "raw_orsa1", "raw_tamq4"]
CELL_GROUPINGS = {"label": ("cohort", "native_label"), "image": ("image_id",)}


def cell_percentiles(cells: DataFrame, error: float = 0.005) -> DataFrame:
    """Percentiles of area and markers per (cohort, native_label) and per image_id, in long form."""
    return RadixPercentiles(cells, CELL_GROUPINGS, CELL_FIELDS).compute(error=error)
