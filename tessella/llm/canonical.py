"""Problem 1: map hand-typed values to the entries of a reference list; report those that denote none.

Distinct values are read (tags and remarks off, stem and member number apart) and looked up in shards of the
reference.  Each shard builds a BK-tree of its stems, which returns every stem within the slips that its kind of name
allows; the shards' candidates are then merged, and the nearest decides.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.joins import skew_join
from tessella.plans.materialize import cut, task_count

from .bktree import BKTree
from .names import bare_names, id_key, key, plain, split_member

#: Slips allowed in the stem of each kind of name.
SLIPS = {"symbol": 1, "full": 2, "alias": 0, "prev": 0, "id": 0, "members": 0}
NAMES = "canon_id string, kind string, stem string, member string"


def _reference_rows(frame: pd.DataFrame) -> pd.DataFrame:
    rows = []
    for canon, symbol, full, aliases, prev, members in frame.itertuples(index=False, name=None):
        if not canon:
            continue
        rows.append((canon, "id", id_key(plain(canon)) or key(canon), ""))
        for kind, text in (("symbol", symbol), ("full", full)):
            if text and plain(text):
                rows.append((canon, kind, *split_member(plain(text))[0]))
        for kind, text in (("alias", aliases), ("prev", prev)):
            rows += [(canon, kind, key(plain(t)), "") for t in (text or "").split("|") if key(plain(t))]
        if members and "|" in members:
            rows.append((canon, "members", "|".join(sorted(key(m) for m in members.split("|"))), ""))
    return pd.DataFrame(rows, columns=["canon_id", "kind", "stem", "member"])


def reference_names(reference: DataFrame) -> DataFrame:
    """One row for each name of each entry; NULL and empty names give none, a NULL ``canon_id`` drops the entry."""
    columns = ["canon_id", "symbol", "full_name", "aliases", "prev_symbol", "members"]
    return reference.select(columns).mapInPandas(lambda fs: (_reference_rows(f) for f in fs), NAMES).distinct()


def readings(value: str | None) -> list[tuple[str, str, str]]:
    """Kind, stem and member of everything that the typed value may be the name of."""
    out = []
    if value and "|" in value:
        out.append(("members", "|".join(sorted(key(v) for v in plain(value).split("|"))), ""))
    for name in bare_names(value):
        identifier = id_key(name)
        if identifier:
            out.append(("id", identifier, ""))
        whole = key(name)
        out += [("alias", whole, ""), ("prev", whole, "")]
        for stem, member in split_member(name):
            if stem:
                out += [("symbol", stem, member), ("full", stem, member)]
    return list(dict.fromkeys(out))


def _read(frames):
    for frame in frames:
        rows = [(v, *r) for v in frame["value"] for r in readings(v)]
        yield pd.DataFrame(rows, columns=["value", "kind", "stem", "member"])


def _search(queries: pd.DataFrame, names: pd.DataFrame) -> pd.DataFrame:
    """All names of one shard within the slips of each asked stem, whatever their member."""
    trees, owners = {}, defaultdict(list)
    for kind, part in names.groupby("kind"):
        trees[kind] = BKTree(part["stem"].unique())
    for canon, kind, stem, member in names[["canon_id", "kind", "stem", "member"]].itertuples(index=False, name=None):
        owners[kind, stem].append((canon, member))
    rows = []
    for kind, stem in queries[["kind", "stem"]].itertuples(index=False, name=None):
        tree = trees.get(kind)
        if tree is None:
            continue
        rows += [(kind, stem, d, canon, member) for other, d in tree.within(stem, SLIPS[kind]) for canon, member in owners[kind, other]]
    return pd.DataFrame(rows, columns=["kind", "stem", "distance", "canon_id", "ref_member"])


def match_values(values: DataFrame, reference: DataFrame, shard_names: int = 20_000, shard_queries: int = 2_000) -> DataFrame:
    """``value`` and ``canon_id`` for each distinct typed value that denotes exactly one entry, with ``distance``.

    ``values`` has one string column ``value``.  A shard holds at most about ``shard_names`` names and is asked for
    about ``shard_queries`` stems at once, so neither side must fit one task.  The nearest stems decide; those
    without the asked member, and a tie between entries, denote nothing.
    """
    distinct = values.where("value is not null").distinct()
    tasks = task_count(values.sparkSession)
    read = cut(distinct.repartition(tasks, "value").mapInPandas(_read, "value string, kind string, stem string, member string"), "readings")
    names = reference_names(reference)
    asked = read.select("kind", "stem").distinct()
    shards = max(1, -(-names.count() // shard_names))
    salts = max(1, -(-asked.count() // shard_queries))
    shard = F.pmod(F.xxhash64("stem"), F.lit(shards)).cast("int")
    left = asked.withColumn("salt", F.pmod(F.xxhash64("stem"), F.lit(salts)).cast("int")).withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    right = names.withColumn("shard", shard).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = (
        left.repartition(tasks, "shard", "salt").groupBy("shard", "salt").cogroup(right.repartition(tasks, "shard", "salt").groupBy("shard", "salt"))
        .applyInPandas(_search, "kind string, stem string, distance int, canon_id string, ref_member string")
    )
    nearest = found.withColumn("least", F.min("distance").over(Window.partitionBy("kind", "stem"))).where("distance = least")
    hits = read.join(nearest.drop("least"), ["kind", "stem"]).where("member = ref_member")
    rank = F.min("distance").over(Window.partitionBy("value"))
    best = hits.withColumn("rank", rank).where("distance = rank")
    return (
        best.groupBy("value").agg(F.min("canon_id").alias("canon_id"), F.max("canon_id").alias("other"), F.min("distance").alias("distance"))
        .where("canon_id = other").drop("other")
    )


def map_registry(registry: DataFrame, reference: DataFrame, key_column: str = "registry_id", columns=("resolved_id", "raw_column", "gene")) -> DataFrame:
    """The entry of each row by its typed columns, in their order: the key, ``canon_id`` ('' if none), ``matched_by``, ``distance``.

    A NULL, empty or stand-in value says nothing; repeated rows stay repeated; other columns aren't read; an empty
    table or an empty reference gives no rows or no matches.
    """
    plain_columns = [F.col(c).cast("string").alias(f"v{i}") for i, c in enumerate(columns)]
    rows = registry.select(F.col(key_column).alias("key"), *plain_columns)
    values = reduce(DataFrame.unionByName, [rows.select(F.col(f"v{i}").alias("value")) for i in range(len(columns))])
    matched = cut(match_values(values, reference), "matches")
    for i in range(len(columns)):
        side = matched.select(F.col("value").alias(f"v{i}"), F.col("canon_id").alias(f"c{i}"), F.col("distance").alias(f"d{i}"))
        rows = skew_join(rows, side, [f"v{i}"], F.col("key"), "left")
    first = F.coalesce(*[F.when(F.col(f"c{i}").isNotNull(), F.struct(F.col(f"c{i}").alias("canon_id"), F.lit(c).alias("matched_by"), F.col(f"d{i}").alias("distance"))) for i, c in enumerate(columns)])
    return rows.select(F.col("key").alias(key_column), first.alias("hit")).select(
        key_column, F.coalesce("hit.canon_id", F.lit("")).alias("canon_id"), F.col("hit.matched_by"), F.col("hit.distance")
    )
