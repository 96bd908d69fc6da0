"""Identity resolution (R)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.operators import identity
from tessella.sources.tables import table

from .registry import Registry

REGISTRY = register = Registry()

_KEY = "upper(regexp_replace({}, '[^A-Za-z0-9]', '', 'g'))"
#: Names of the reference with their rank: symbol, alias, former symbol, full name.
_NAMES = f"""names AS (SELECT canon_id, 1 AS rank, {_KEY.format('symbol')} AS key FROM marker_reference
UNION ALL SELECT canon_id, 2, {_KEY.format('a')} FROM (SELECT canon_id, unnest(string_split(aliases, '|')) AS a FROM marker_reference)
UNION ALL SELECT canon_id, 3, {_KEY.format('prev_symbol')} FROM marker_reference UNION ALL SELECT canon_id, 4, {_KEY.format('full_name')} FROM marker_reference),
good AS (SELECT rank, key, min(canon_id) AS canon_id FROM names WHERE key <> '' GROUP BY 1, 2 HAVING count(DISTINCT canon_id) = 1),
best AS (SELECT key, arg_min(canon_id, rank) AS canon_id, min(rank) AS rank FROM good GROUP BY 1)"""
_RESOLVED = f"""WITH {_NAMES}, reg AS (SELECT *, {_KEY.format("coalesce(core, '')")} AS key FROM marker_registry),
res AS (SELECT registry_id, cohort, core, panel_id, best.canon_id AS entry, coalesce(['symbol', 'alias', 'prev', 'full'][best.rank], 'unresolved') AS via FROM reg LEFT JOIN best USING (key))"""


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return identity.resolve(table(spark, d, "marker_registry"), table(spark, d, "marker_reference"))


@register(f"""WITH a AS (SELECT canon_id, {_KEY.format('n')} AS key FROM (SELECT canon_id, unnest(string_split(aliases, '|') || [symbol]) AS n FROM marker_reference))
SELECT key, max(canon_id) AS canon_id, count(DISTINCT canon_id) AS n_writers FROM a WHERE key <> '' GROUP BY 1""")
def alias_table(spark: SparkSession, d: str) -> DataFrame:
    """Every symbol and alias to its entry, the last writer wins."""
    return identity.alias_table(table(spark, d, "marker_reference"))


@register(_RESOLVED + " SELECT registry_id, entry, via FROM res")
def resolver(spark: SparkSession, d: str) -> DataFrame:
    """R2: symbol, alias, former symbol, full name, in this order; what is left stays unresolved."""
    return _resolved(spark, d).select("registry_id", "entry", "via")


@register(_RESOLVED + f""", fam AS (SELECT key, min(canon_id) AS f FROM (SELECT canon_id, {_KEY.format('unnest([symbol, full_name])')} AS key FROM marker_reference WHERE kind = 'FAMILY') WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT canon_id) = 1),
said AS (SELECT key, min(resolved_id) AS s FROM reg WHERE key <> '' AND resolved_id IN (SELECT canon_id FROM marker_reference) GROUP BY 1 HAVING count(DISTINCT resolved_id) = 1)
SELECT registry_id, coalesce(f, s, entry) AS entry, CASE WHEN f IS NOT NULL THEN 'complex' WHEN s IS NOT NULL THEN 'override' ELSE via END AS via
FROM res JOIN (SELECT registry_id, key FROM reg) USING (registry_id) LEFT JOIN fam USING (key) LEFT JOIN said USING (key)""")
def resolver_tiers(spark: SparkSession, d: str) -> DataFrame:
    """R2: complexes, then overrides, then symbol, alias, former symbol and full name."""
    r = identity.resolve_in_tiers(table(spark, d, "marker_registry"), table(spark, d, "marker_reference"))
    return r.select("registry_id", "entry", "via")


@register(f"""WITH {_NAMES}, v AS (SELECT registry_id, {_KEY.format('unnest([core, stripped, gene])')} AS key FROM marker_registry),
h AS (SELECT registry_id, count(DISTINCT canon_id) AS k, min(canon_id) AS e FROM v JOIN best USING (key) GROUP BY 1)
SELECT registry_id, CASE WHEN k = 1 THEN e END AS entry, CASE WHEN k = 1 THEN 'agreed' ELSE 'conflict' END AS outcome FROM h""")
def agreement_rule(spark: SparkSession, d: str) -> DataFrame:
    """Spellings vote; one distinct answer is accepted, several are a conflict."""
    return identity.vote(table(spark, d, "marker_registry"), table(spark, d, "marker_reference"), ["core", "stripped", "gene"])


@register("""WITH t AS (SELECT full_name, canon_id, row_number() OVER (PARTITION BY split_part(full_name, ' ', 1) ORDER BY length(full_name), canon_id) AS rn,
split_part(full_name, ' ', 1) AS stem, length(full_name) AS score FROM marker_reference WHERE full_name <> '')
SELECT a.stem, a.canon_id AS entry, b.score IS NOT NULL AND a.score = b.score AS ambiguous FROM t a LEFT JOIN t b ON b.stem = a.stem AND b.rn = 2 WHERE a.rn = 1""")
def top_hit(spark: SparkSession, d: str) -> DataFrame:
    """The best of several hits, ambiguous if the second is as good."""
    return identity.top_hit(table(spark, d, "marker_reference"))


@register(_RESOLVED + " SELECT registry_id, core, CASE WHEN entry IS NULL THEN '' ELSE entry || '|' || e.epitope || '|' || e.modification END AS triple FROM res JOIN (SELECT registry_id, epitope, modification FROM marker_registry) e USING (registry_id)")
def registry_build(spark: SparkSession, d: str) -> DataFrame:
    """The triple of entry, epitope and modification; an empty text if unresolved."""
    r = _resolved(spark, d)
    return r.select("registry_id", "core", F.when(F.col("entry").isNull(), "").otherwise(F.concat_ws("|", "entry", "epitope", "modification")).alias("triple"))


@register(_RESOLVED + " SELECT cohort, via, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY cohort), 6) AS pct FROM res GROUP BY 1, 2")
def coverage_gate(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes per cohort and source, with their share."""
    return identity.outcome_shares(_resolved(spark, d), "cohort", "via")


@register(_RESOLVED + """ SELECT (SELECT count(*) FROM (SELECT core FROM res WHERE core <> '' GROUP BY 1 HAVING count(DISTINCT cohort) >= 2)) AS raw_shared,
(SELECT count(*) FROM (SELECT entry FROM res WHERE entry IS NOT NULL GROUP BY 1 HAVING count(DISTINCT cohort) >= 2)) AS resolved_shared""")
def sharing_gain(spark: SparkSession, d: str) -> DataFrame:
    """Names and entries that two cohorts or more share."""
    r = _resolved(spark, d)

    def shared(c: str, name: str) -> DataFrame:
        groups = r.where(F.col(c).isNotNull() & (F.col(c) != "")).groupBy(c).agg(F.count_distinct("cohort").alias("k")).where("k >= 2")
        return groups.agg(F.count(F.lit(1)).alias(name))

    return shared("core", "raw_shared").join(shared("entry", "resolved_shared"))


_MEMBERS = "mem AS (SELECT canon_id AS family, unnest(string_split(members, '|')) AS symbol FROM marker_reference WHERE members <> '')"


@register(_RESOLVED + f""", {_MEMBERS}, got AS (SELECT {_KEY.format("coalesce(core, '')")} AS key, min(entry) AS entry FROM res GROUP BY 1),
p AS (SELECT a.family, a.symbol AS a, b.symbol AS b FROM mem a JOIN mem b ON a.family = b.family AND a.symbol < b.symbol),
j AS (SELECT p.*, x.key AS xa, y.key AS xb, x.entry AS ea, y.entry AS eb FROM p LEFT JOIN got x ON x.key = upper(a) LEFT JOIN got y ON y.key = upper(b))
SELECT family, a, b, CASE WHEN xa IS NULL OR xb IS NULL THEN 'NOT IN DATA' WHEN ea IS NULL OR eb IS NULL THEN 'UNRESOLVED' WHEN ea = eb THEN 'FAIL' ELSE 'PASS' END AS outcome FROM j""")
def never_merge(spark: SparkSession, d: str) -> DataFrame:
    """Members of a family must stay apart."""
    return identity.never_merge(_resolved(spark, d), table(spark, d, "marker_reference"))


@register(f"""WITH {_NAMES}, g AS (SELECT canon_id AS expected, {_KEY.format('unnest(string_split(aliases, chr(124)) || [symbol, full_name])')} AS key FROM marker_reference)
SELECT expected, count(DISTINCT g.key) AS n_names, count(DISTINCT best.canon_id) AS n_entries, bool_and(best.canon_id IS NOT NULL AND best.canon_id = expected) AS pass FROM g LEFT JOIN best USING (key) WHERE key <> '' GROUP BY 1""")
def must_merge(spark: SparkSession, d: str) -> DataFrame:
    """All names of an entry must come to it; an unresolved one fails."""
    return identity.must_merge(table(spark, d, "marker_reference"))


@register(_RESOLVED + " SELECT r.registry_id, r.entry, m.kind FROM res r JOIN marker_reference m ON m.canon_id = r.entry WHERE m.kind NOT IN ('PROTEIN', 'FAMILY')")
def non_protein_leak(spark: SparkSession, d: str) -> DataFrame:
    """Rows resolved to entries that are no protein."""
    kinds = table(spark, d, "marker_reference").select(F.col("canon_id").alias("entry"), F.col("kind").alias("of_kind")).where(~F.col("of_kind").isin("PROTEIN", "FAMILY"))
    return _resolved(spark, d).join(kinds, "entry").select("registry_id", "entry", F.col("of_kind").alias("kind"))


@register(_RESOLVED + " SELECT k AS n_cohorts, count(*) AS n_entries FROM (SELECT entry, count(DISTINCT cohort) AS k FROM res WHERE entry IS NOT NULL GROUP BY 1) GROUP BY 1")
def availability(spark: SparkSession, d: str) -> DataFrame:
    """In how many cohorts the entries occur."""
    k = _resolved(spark, d).where("entry is not null").groupBy("entry").agg(F.count_distinct("cohort").alias("n_cohorts"))
    return k.groupBy("n_cohorts").agg(F.count(F.lit(1)).alias("n_entries"))


@register(_RESOLVED + " SELECT core, count(*) AS n, string_agg(DISTINCT cohort, ', ' ORDER BY cohort) AS cohorts FROM res WHERE entry IS NULL AND core <> '' GROUP BY 1")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Unresolved names with their cohorts."""
    left = _resolved(spark, d).where("entry is null and core <> ''")
    return left.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("cohort")), ", ").alias("cohorts"))
