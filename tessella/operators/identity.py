"""Column identity: names resolved to entries by exact keys in a declared order, votes, and the checks on them.

Values written with slips or tags are the business of the mapping operator; these never guess.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.names import ascii_key
from tessella.functions.numbers import fixed

SOURCES = ("symbol", "alias", "prev", "full")


def reference_keys(reference: DataFrame) -> DataFrame:
    """Key, rank of its source and entry; keys that two entries of one source share are left out."""
    one = [F.struct(F.lit(1).alias("rank"), F.col("symbol").alias("name")), F.struct(F.lit(3).alias("rank"), F.col("prev_symbol").alias("name")), F.struct(F.lit(4).alias("rank"), F.col("full_name").alias("name"))]
    aliases = F.transform(F.coalesce(F.split("aliases", r"\|"), F.array().cast("array<string>")), lambda a: F.struct(F.lit(2).alias("rank"), a.alias("name")))
    names = reference.select("canon_id", F.inline(F.concat(F.array(*one), aliases))).select("canon_id", "rank", ascii_key(F.col("name")).alias("key")).where("key <> ''")
    return names.groupBy("rank", "key").agg(F.min("canon_id").alias("canon_id"), F.max("canon_id").alias("other")).where("canon_id = other").drop("other")


def best_keys(reference: DataFrame) -> DataFrame:
    """Each key's entry by its first source."""
    return reference_keys(reference).groupBy("key").agg(F.min(F.struct("rank", "canon_id")).alias("b")).select("key", F.col("b.canon_id").alias("entry"), F.col("b.rank").alias("rank"))


def resolve(registry: DataFrame, reference: DataFrame) -> DataFrame:
    """``registry`` with ``entry`` (NULL if unresolved) and ``via``; NULL and empty names stay unresolved."""
    keyed = registry.withColumn("key", ascii_key(F.coalesce("core", F.lit(""))))
    via = F.when(F.col("rank").isNull(), "unresolved").otherwise(F.element_at(F.array(*map(F.lit, SOURCES)), F.coalesce("rank", F.lit(1))))
    return keyed.join(best_keys(reference), "key", "left").withColumn("via", via)


def resolve_in_tiers(registry: DataFrame, reference: DataFrame) -> DataFrame:
    """As ``resolve``, but families (complexes) come first, then what the registry's own well-written ids say of a name.

    A name that two families, or two ids, would take is left to the next tier.
    """
    families = reference.where("kind = 'FAMILY'").select("canon_id", F.explode(F.array("symbol", "full_name")).alias("name"))
    said = registry.select(F.col("resolved_id").alias("canon_id"), F.col("core").alias("name")).join(reference.select("canon_id").distinct(), "canon_id", "left_semi")

    def sole(names: DataFrame, entry: str) -> DataFrame:
        keys = names.select("canon_id", ascii_key(F.col("name")).alias("key")).where("key <> ''")
        return keys.groupBy("key").agg(F.min("canon_id").alias(entry), F.max("canon_id").alias("_other")).where(F.col(entry) == F.col("_other")).drop("_other")

    found = resolve(registry, reference).join(sole(families, "_family"), "key", "left").join(sole(said, "_said"), "key", "left")
    via = F.when(F.col("_family").isNotNull(), "complex").when(F.col("_said").isNotNull(), "override").otherwise(F.col("via"))
    return found.withColumns({"via": via, "entry": F.coalesce("_family", "_said", "entry")}).drop("_family", "_said")


def alias_table(reference: DataFrame) -> DataFrame:
    """Each symbol and alias with the entry that wrote it last (the greatest id), and the number of writers."""
    names = F.concat(F.coalesce(F.split("aliases", r"\|"), F.array().cast("array<string>")), F.array("symbol"))
    keys = reference.select("canon_id", F.explode(names).alias("n")).select("canon_id", ascii_key(F.col("n")).alias("key")).where("key <> ''")
    return keys.groupBy("key").agg(F.max("canon_id").alias("canon_id"), F.count_distinct("canon_id").alias("n_writers"))


def vote(registry: DataFrame, reference: DataFrame, columns: list[str]) -> DataFrame:
    """One distinct answer of several spellings is accepted; rows without any answer don't appear."""
    spelled = registry.select("registry_id", F.explode(F.array(*columns)).alias("name")).select("registry_id", ascii_key(F.col("name")).alias("key"))
    hits = spelled.join(best_keys(reference), "key").groupBy("registry_id").agg(F.min("entry").alias("first"), F.max("entry").alias("last"))
    agreed = F.col("first") == F.col("last")
    return hits.select("registry_id", F.when(agreed, F.col("first")).alias("entry"), F.when(agreed, "agreed").otherwise("conflict").alias("outcome"))


def top_hit(reference: DataFrame) -> DataFrame:
    """For each first word of the full names its shortest entry, and whether a second is as short."""
    named = reference.where("full_name <> ''").withColumn("stem", F.substring_index("full_name", " ", 1)).withColumn("score", F.length("full_name"))
    w = Window.partitionBy("stem").orderBy("score", "canon_id")
    ranked = named.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("score").over(w))
    return ranked.where("rn = 1").select("stem", F.col("canon_id").alias("entry"), F.coalesce(F.col("score") == F.col("next"), F.lit(False)).alias("ambiguous"))


def outcome_shares(resolved: DataFrame, group: str, outcome: str) -> DataFrame:
    counts = resolved.groupBy(group, outcome).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", fixed(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)), 6))


def never_merge(resolved: DataFrame, reference: DataFrame) -> DataFrame:
    """Pairs of family members: PASS if apart, FAIL if merged, UNRESOLVED, or NOT IN DATA."""
    members = reference.where("members <> ''").select(F.col("canon_id").alias("family"), F.explode(F.split("members", r"\|")).alias("a"))
    pairs = members.join(members.withColumnRenamed("a", "b"), "family").where("a < b")
    got = resolved.groupBy("key").agg(F.min("entry").alias("entry"))
    x = got.select(F.col("key").alias("ka"), F.col("entry").alias("ea"))
    y = got.select(F.col("key").alias("kb"), F.col("entry").alias("eb"))
    joined = pairs.join(x, F.upper("a") == F.col("ka"), "left").join(y, F.upper("b") == F.col("kb"), "left")
    outcome = (
        F.when(F.col("ka").isNull() | F.col("kb").isNull(), "NOT IN DATA").when(F.col("ea").isNull() | F.col("eb").isNull(), "UNRESOLVED")
        .when(F.col("ea") == F.col("eb"), "FAIL").otherwise("PASS")
    )
    return joined.select("family", "a", "b", outcome.alias("outcome"))


def must_merge(reference: DataFrame) -> DataFrame:
    """For each entry, whether all its names resolve to it."""
    names = F.concat(F.coalesce(F.split("aliases", r"\|"), F.array().cast("array<string>")), F.array("symbol", "full_name"))
    keys = reference.select(F.col("canon_id").alias("expected"), F.explode(names).alias("n")).select("expected", ascii_key(F.col("n")).alias("key")).where("key <> ''")
    joined = keys.join(best_keys(reference), "key", "left")
    return joined.groupBy("expected").agg(
        F.count_distinct("key").alias("n_names"), F.count_distinct("entry").alias("n_entries"),
        F.bool_and(F.col("entry").isNotNull() & F.coalesce(F.col("entry") == F.col("expected"), F.lit(False))).alias("pass"),
    )
