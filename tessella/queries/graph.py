"""Graphs of labels and of terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions.numbers import fixed
from tessella.operators import graphs, matching
from tessella.plans.materialize import cut
from tessella.sources.standard import stored_counts
from tessella.sources.tables import table

from .joins import MEANS
from .registry import Registry

REGISTRY = register = Registry()

_EDGES = MEANS + """, p AS (SELECT a.cohort, a.label, b.cohort AS other, b.label AS nearest, sqrt(avg((a.z - b.z) * (a.z - b.z))) AS distance FROM z a JOIN z b USING (marker)
WHERE a.cohort <> b.cohort AND a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY ALL HAVING count(*) >= 3),
r AS (SELECT *, row_number() OVER (PARTITION BY cohort, label ORDER BY round(distance, 9), nearest, other) AS rn FROM p), e AS (SELECT cohort || '|' || label AS a, other || '|' || nearest AS b FROM r WHERE rn <= 2)"""
_REACH = _EDGES + ", reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Each label to its two nearest labels of other cohorts."""
    profiles = matching.standard_profiles(stored_counts(spark, d, "cohort", "label"), ["cohort"], "label", least=100)
    w = Window.partitionBy("cohort_a", "label_a").orderBy(fixed("distance", 9), "label_b", "cohort_b")
    near = matching.squares(cut(profiles, "profiles"), 3).withColumn("rn", F.row_number().over(w)).where("rn <= 2")
    return cut(near.select(F.concat_ws("|", "cohort_a", "label_a").alias("a"), F.concat_ws("|", "cohort_b", "label_b").alias("b")), "edges")


@register("WITH RECURSIVE " + _REACH + ", nodes AS (SELECT a AS node FROM e UNION SELECT b FROM e) SELECT node, least(node, coalesce((SELECT min(x.b) FROM reach x JOIN reach y ON y.a = x.b AND y.b = x.a WHERE x.a = node), node)) AS component FROM nodes")
def scc_contract(spark: SparkSession, d: str) -> DataFrame:
    """Strongly connected labels contracted, so that what remains is acyclic."""
    return graphs.contract(_edges(spark, d))


@register("WITH RECURSIVE " + _REACH + """, direct AS (SELECT a, b FROM e), shared AS (SELECT cohort || '|' || label AS a, other || '|' || nearest AS b FROM p)
SELECT r.a, r.b, CASE WHEN s.a IS NULL THEN 'bridged' ELSE 'measured' END AS kind FROM reach r ANTI JOIN direct x USING (a, b) LEFT JOIN shared s ON s.a = r.a AND s.b = r.b WHERE r.a <> r.b""")
def closure_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that only a path connects; bridged where they share too little to be measured."""
    edges = _edges(spark, d)
    profiles = matching.standard_profiles(stored_counts(spark, d, "cohort", "label"), ["cohort"], "label", least=100)
    shared = matching.squares(cut(profiles, "profiles"), 3).select(F.concat_ws("|", "cohort_a", "label_a").alias("a"), F.concat_ws("|", "cohort_b", "label_b").alias("b"), F.lit(True).alias("known"))
    pairs = graphs.reachability(edges).where("a <> b").join(edges, ["a", "b"], "left_anti").join(shared, ["a", "b"], "left")
    return pairs.select("a", "b", F.when(F.col("known"), "measured").otherwise("bridged").alias("kind"))


_TERMS = """RECURSIVE w AS (SELECT DISTINCT string_split(label, ' ') AS w FROM label_map), i AS (SELECT w, unnest(range(1, len(w) + 1)) AS i FROM w), s AS (SELECT w, i, unnest(range(i, len(w) + 1)) AS j FROM i),
t AS (SELECT DISTINCT w[i:j] AS t FROM s WHERE j > i), isa AS (SELECT array_to_string(t, ' ') AS child, array_to_string(t[2:], ' ') AS parent FROM t UNION SELECT array_to_string(t, ' '), array_to_string(t[:-2], ' ') FROM t),
terms AS (SELECT child AS term FROM isa UNION SELECT parent FROM isa),
anc AS (SELECT term, term AS ancestor, 0 AS steps FROM terms UNION SELECT anc.term, isa.parent, anc.steps + 1 FROM anc JOIN isa ON isa.child = anc.ancestor WHERE anc.steps < 40),
clo AS (SELECT term, ancestor, min(steps) AS steps FROM anc GROUP BY 1, 2)"""


def _closure(spark: SparkSession, d: str) -> DataFrame:
    return graphs.ancestors(cut(graphs.label_terms(table(spark, d, "label_map").select("label").distinct()), "terms"))


@register(f"WITH {_TERMS} SELECT term, ancestor, steps FROM clo")
def ancestors(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors of the terms that labels are made of."""
    return _closure(spark, d)


_NEAR = _TERMS + """, hit AS (SELECT term, ancestor, steps, min(steps) OVER (PARTITION BY term) AS least FROM clo WHERE ancestor NOT LIKE '% %'),
near AS (SELECT term, min(ancestor) AS nearest, min(steps) AS steps, count(*) > 1 AS tie FROM hit WHERE steps = least GROUP BY 1)"""


@register(f"WITH {_NEAR} SELECT term, nearest, steps, tie FROM near")
def nearest_subset(spark: SparkSession, d: str) -> DataFrame:
    """The nearest ancestor of one word, with a flag where several are as near."""
    closure = _closure(spark, d)
    return graphs.nearest_in(closure, closure.where(~F.col("ancestor").contains(" ")).select("ancestor"))


@register(f"""WITH {_NEAR}, x AS (SELECT DISTINCT label, cluster FROM label_map),
p AS (SELECT a.label AS a, b.label AS b, a.cluster = b.cluster AS same FROM x a JOIN x b ON a.label <= b.label AND (a.label < b.label OR a.cluster < b.cluster)),
k AS (SELECT CASE WHEN a = b THEN 'same' WHEN EXISTS (SELECT 1 FROM clo WHERE (term = p.a AND ancestor = p.b) OR (term = p.b AND ancestor = p.a)) THEN 'parent-child' WHEN m.nearest = n.nearest THEN 'same upper' ELSE 'distant' END AS relation, same
FROM p LEFT JOIN near m ON m.term = a LEFT JOIN near n ON n.term = b) SELECT relation, count(*) AS n, count(*) FILTER (WHERE same) AS n_together FROM k GROUP BY 1""")
def pair_relations(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of labels by their relation as terms, and how many are in one cluster."""
    closure = _closure(spark, d)
    near = graphs.nearest_in(closure, closure.where(~F.col("ancestor").contains(" ")).select("ancestor")).select("term", "nearest")
    x = table(spark, d, "label_map").select("label", "cluster").distinct()
    y = x.select(F.col("label").alias("b"), F.col("cluster").alias("cluster_b"))
    pairs = x.withColumnRenamed("label", "a").join(y, (F.col("a") < F.col("b")) | ((F.col("a") == F.col("b")) & (F.col("cluster") < F.col("cluster_b"))))
    up = closure.select(F.least("term", "ancestor").alias("a"), F.greatest("term", "ancestor").alias("b")).where("a <> b").distinct().withColumn("line", F.lit(True))
    j = pairs.join(up, ["a", "b"], "left").join(near.toDF("a", "near_a"), "a", "left").join(near.toDF("b", "near_b"), "b", "left")
    relation = F.when(F.col("a") == F.col("b"), "same").when(F.col("line"), "parent-child").when(F.col("near_a") == F.col("near_b"), "same upper").otherwise("distant")
    return j.groupBy(relation.alias("relation")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("cluster") == F.col("cluster_b")).alias("n_together"))


@register(f"WITH {_NEAR}, two AS (SELECT term, min(ancestor) AS broad FROM (SELECT *, min(steps) OVER (PARTITION BY term) AS least FROM clo WHERE length(ancestor) - length(replace(ancestor, ' ', '')) <= 1) WHERE steps = least GROUP BY 1) SELECT DISTINCT l.label, two.broad, near.nearest AS upper_ FROM label_map l JOIN two ON two.term = l.label JOIN near ON near.term = l.label")
def level_projection(spark: SparkSession, d: str) -> DataFrame:
    """Each label's term on two levels."""
    closure = _closure(spark, d)
    spaces = F.length("ancestor") - F.length(F.replace(F.col("ancestor"), F.lit(" "), F.lit("")))
    levels = {name: graphs.nearest_in(closure, closure.where(spaces <= most)).select("term", F.col("nearest").alias(name)) for name, most in (("broad", 1), ("upper_", 0))}
    labels = table(spark, d, "label_map").select(F.col("label").alias("term")).distinct()
    return labels.join(levels["broad"], "term").join(levels["upper_"], "term").select(F.col("term").alias("label"), "broad", "upper_")
