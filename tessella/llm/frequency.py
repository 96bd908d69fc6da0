"""Problem 2: how often each label and each word occurs, in cells and in slides, by suffix-sorted counting.

Records (cells, slides) with the same set of labels form one class with a weight, so counting works on classes.  Of
each label's term sequence the suffixes, cut at the length of the longest n-gram asked for, are routed by their first
term, salted by class; sorted in reverse lexicographic order, every n-gram that a suffix begins with is then complete as
soon as the order leaves it, and a stack of class sets counts all of them in one pass.  A class lives in one salt, so the
salts' counts add up, and there are as many salts as keep a task's sets small.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.plans.materialize import cut

#: Labels that stand for no label.
NO_LABEL = ("", "nan", "none", "null", "na")
START, END = "\x01", "\x02"
_runs = re.compile(r"[\s_\-]+")


def standard_label(text: str) -> str:
    """NFKC, lower case, runs of white space, ``_`` and ``-`` as one space, trimmed."""
    return _runs.sub(" ", unicodedata.normalize("NFKC", text).lower()).strip()


def _standard(column: str) -> Column:
    def run(values: pd.Series) -> pd.Series:
        known = {v: standard_label(v) for v in values.dropna().unique()}
        return values.map(known)

    return F.pandas_udf(run, T.StringType())(column)


def standard_cohort(column: Column) -> Column:
    return F.upper(F.trim(column))


def _stack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of every n-gram from suffixes sorted in reverse lexicographic order within a first term and salt."""
    terms: list[str] = []
    sets: list[dict] = []
    place = None
    rows: list[tuple] = []

    def leave(depth: int) -> None:
        while len(terms) > depth:
            seen = sets.pop()
            for unit in ("cell", "slide"):
                n = sum(w for (u, _), w in seen.items() if u == unit)
                if n:
                    rows.append((list(terms), unit, n))
            terms.pop()
            if sets:
                sets[-1].update(seen)

    for frame in frames:
        for salt, suffix, unit, record, weight in frame.itertuples(index=False, name=None):
            suffix = list(suffix)
            if (suffix[0], salt) != place:
                leave(0)
                place = suffix[0], salt
            shared = 0
            while shared < min(len(terms), len(suffix)) and terms[shared] == suffix[shared]:
                shared += 1
            leave(shared)
            for term in suffix[shared:]:
                terms.append(term)
                sets.append({})
            sets[-1][unit, record] = weight
        yield pd.DataFrame(rows, columns=["gram", "unit", "n"])
        rows.clear()
    leave(0)
    yield pd.DataFrame(rows, columns=["gram", "unit", "n"])


def record_classes(cells: DataFrame) -> DataFrame:
    """Unit (cell or slide), its sorted set of (cohort, label), the number of such records, and the class's name.

    Rows without label, cohort or slide don't count; a NULL ``cell_id`` counts for its slide only.  The rows are read
    once; labels are put into their standard writing when only the different sets of them are left.
    """
    units = F.array(F.struct(F.lit("cell").alias("unit"), F.col("cell_id").cast("string").alias("key")), F.struct(F.lit("slide").alias("unit"), F.col("image_id").alias("key")))
    raw = (
        cells.where("cohort is not null and native_label is not null and image_id is not null and trim(image_id) <> ''")
        .select(F.struct("cohort", F.col("native_label").alias("label")).alias("pair"), F.inline(units)).where("key is not null")
    )
    sets = raw.groupBy("unit", "key").agg(F.array_sort(F.collect_set("pair")).alias("pairs"))
    written = cut(sets.groupBy("unit", "pairs").agg(F.count(F.lit(1)).alias("weight")).withColumn("no", F.sha1(F.to_json("pairs"))), "written")
    one = written.select("unit", "no", "weight", F.explode("pairs").alias("pair")).select("unit", "no", "weight", standard_cohort(F.col("pair.cohort")).alias("cohort"), _standard("pair.label").alias("label"))
    named = one.where("cohort <> ''").where(~F.col("label").isin(*NO_LABEL))
    standard = named.groupBy("unit", "no", "weight").agg(F.array_sort(F.collect_set(F.struct("cohort", "label"))).alias("pairs"))
    classes = standard.groupBy("unit", "pairs").agg(F.sum("weight").alias("weight"))
    return cut(classes.withColumn("record", F.sha1(F.to_json("pairs"))), "classes")


def label_terms(
    cells: DataFrame, phrase: int = 1, salt_classes: int = 50_000, few_slides: int = 3, few_cells: int = 5, most: float = 0.9
) -> DataFrame:
    """``scope``, ``term``, ``n_cells``, ``n_slides`` and ``mark`` of each cohort's labels and of all words.

    ``scope`` is the cohort for whole labels and ``*`` for words (with ``phrase`` over 1 also for their n-grams).
    ``mark`` is ``rare`` (a label on fewer than ``few_slides`` slides or in fewer than ``few_cells`` different cells;
    a word on fewer than ``few_slides`` slides), ``common`` (on more than ``most`` of the counted slides of the
    cohort, or of all) or NULL.  Rows without label, cohort or slide don't count; repeated cells count once; other
    columns aren't read; an empty table gives no rows.
    """
    classes = record_classes(cells)
    salts = max(1, -(-classes.count() // salt_classes))
    one = classes.select("unit", "record", "weight", F.explode("pairs").alias("pair")).select("unit", "record", "weight", "pair.*")
    words = F.split("label", " ")
    sequence = F.concat(F.array(F.concat(F.lit(START), "cohort")), words, F.array(F.lit(END)))
    pieces = F.transform(F.sequence(F.lit(1), F.size(words)), lambda i: F.slice(words, i, phrase))
    suffixes = (
        one.select("unit", "record", "weight", F.explode(F.concat(F.array(sequence), pieces)).alias("suffix"))
        .withColumn("salt", F.pmod(F.xxhash64("record"), F.lit(salts)).cast("int")).distinct()
    )
    sorted_suffixes = (
        suffixes.withColumn("first", F.col("suffix")[0]).repartition("first", "salt")
        .sortWithinPartitions("first", "salt", F.desc("suffix")).select("salt", "suffix", "unit", "record", "weight")
    )
    counted = sorted_suffixes.mapInPandas(_stack, "gram array<string>, unit string, n long")
    whole = F.col("gram")[0].startswith(START)
    counts = (
        counted.where(~whole | (F.element_at("gram", -1) == END))
        .select(
            F.when(whole, F.substring(F.col("gram")[0], 2, 1 << 30)).otherwise("*").alias("scope"),
            F.when(whole, F.array_join(F.expr("slice(gram, 2, size(gram) - 2)"), " ")).otherwise(F.array_join("gram", " ")).alias("term"),
            "unit", "n",
        )
        .groupBy("scope", "term")
        .agg(
            F.coalesce(F.sum(F.when(F.col("unit") == "cell", F.col("n"))), F.lit(0)).alias("n_cells"),
            F.coalesce(F.sum(F.when(F.col("unit") == "slide", F.col("n"))), F.lit(0)).alias("n_slides"),
        )
    )
    slides = classes.where("unit = 'slide'")
    scopes = F.array_union(F.array(F.lit("*")), F.col("pairs.cohort"))
    totals = slides.select("weight", F.explode(F.array_distinct(scopes)).alias("scope")).groupBy("scope").agg(F.sum("weight").alias("all_slides"))
    few = (F.col("n_slides") < few_slides) | ((F.col("scope") != "*") & (F.col("n_cells") < few_cells))
    mark = F.when(few, "rare").when(F.col("n_slides") > most * F.col("all_slides"), "common")
    return counts.join(totals, "scope").select("scope", "term", "n_cells", "n_slides", "all_slides", mark.alias("mark"))
