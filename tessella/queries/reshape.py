"""Set and reshape operations, scalar functions (G, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import names, vectors
from tessella.functions.numbers import fixed
from tessella.operators import schema
from tessella.plans.materialize import broadcast_up_to, cut
from tessella.sources.standard import MARKERS, long_values, standard_cells, value_counts
from tessella.sources.tables import table

from .registry import L, M, Registry

REGISTRY = register = Registry()


@register(f"WITH {M} SELECT 'map' AS source, cohort, label FROM label_map UNION ALL SELECT DISTINCT 'cells', cohort, label FROM m")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    """G1: rows of two sources under each other, columns by name."""
    cells = standard_cells(spark, d).select(F.lit("cells").alias("source"), "cohort", "label").distinct()
    return table(spark, d, "label_map").select("label", "cohort", F.lit("map").alias("source")).unionByName(cells)


@register("SELECT a.load_id, a.cohort, b.n AS n_rows FROM loads a JOIN (SELECT load_id, count(*) AS n FROM cells GROUP BY 1) b USING (load_id)")
def column_concat(spark: SparkSession, d: str) -> DataFrame:
    """Columns of two frames side by side, by their row id."""
    schema.no_clash(table(spark, d, "loads").select("load_id", "cohort"), ["n_rows"])
    counted = table(spark, d, "cells").groupBy("load_id").agg(F.count(F.lit(1)).alias("n_rows"))
    return table(spark, d, "loads").select("load_id", "cohort").join(counted, "load_id")


@register("SELECT DISTINCT name FROM (SELECT unnest(string_split(aliases, '|')) AS name FROM marker_reference UNION ALL SELECT symbol FROM marker_reference) WHERE name <> ''")
def exploded_union(spark: SparkSession, d: str) -> DataFrame:
    """All names in delimited lists, as a set."""
    ref = table(spark, d, "marker_reference")
    return ref.select(F.explode(F.split("aliases", r"\|")).alias("name")).unionByName(ref.select(F.col("symbol").alias("name"))).where("name <> ''").distinct()


@register("SELECT symbol AS name FROM marker_reference INTERSECT SELECT gene FROM marker_registry")
def set_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Symbols in use."""
    return table(spark, d, "marker_reference").select(F.col("symbol").alias("name")).intersect(table(spark, d, "marker_registry").select("gene"))


@register("""WITH p AS (SELECT a.cohort, a.label AS a, b.label AS b, a.cluster = b.cluster AS now, a.cluster_name = b.cluster_name AND a.unreliable = b.unreliable AS then_
FROM label_map a JOIN label_map b ON a.cohort = b.cohort AND a.label < b.label)
SELECT cohort, a, b, CASE WHEN now THEN 'gained' ELSE 'lost' END AS mate FROM p WHERE now <> then_""")
def set_diff_mates(spark: SparkSession, d: str) -> DataFrame:
    """Mates gained and lost between two partitions of the labels."""
    x = table(spark, d, "label_map").select("cohort", "label", "cluster", "cluster_name", "unreliable")
    y = x.select("cohort", *[F.col(c).alias(f"{c}_b") for c in ("label", "cluster", "cluster_name", "unreliable")])
    p = x.join(y, "cohort").where("label < label_b").withColumn("now", F.expr("cluster = cluster_b")).withColumn("then_", F.expr("cluster_name = cluster_name_b and unreliable = unreliable_b"))
    return p.where("now <> then_").select("cohort", F.col("label").alias("a"), F.col("label_b").alias("b"), F.when(F.col("now"), "gained").otherwise("lost").alias("mate"))


@register(f"WITH {L}, w AS (SELECT cohort, marker, round(avg(v), 6) AS mean FROM l GROUP BY 1, 2) SELECT cohort, " + ", ".join(f"max(CASE WHEN marker = '{m}' THEN mean END) AS {m}" for m in MARKERS) + " FROM w GROUP BY 1")
def long_and_back(spark: SparkSession, d: str) -> DataFrame:
    """Wide to long, then long to wide over declared columns."""
    long = long_values(standard_cells(spark, d), "cohort")
    return long.groupBy("cohort").pivot("marker", list(MARKERS)).agg(fixed(F.avg("v"), 6))


@register(f"""WITH {L}, vocab AS (SELECT marker, row_number() OVER (ORDER BY marker) - 1 AS idx FROM (SELECT DISTINCT marker FROM l)), k AS (SELECT DISTINCT cohort FROM l),
s AS (SELECT cohort, marker, avg(v) AS x FROM l GROUP BY 1, 2)
SELECT k.cohort, vocab.idx, round(coalesce(x, 0), 6) AS x, x IS NOT NULL AS present FROM k CROSS JOIN vocab LEFT JOIN s ON s.cohort = k.cohort AND s.marker = vocab.marker""")
def dense_scatter(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary of markers, and each cohort's values in its slots with a mask of what is present."""
    s = long_values(standard_cells(spark, d), "cohort").groupBy("cohort", "marker").agg(F.avg("v").alias("x"))
    vocabulary = s.groupBy().agg(F.array_sort(F.collect_set("marker")).alias("slots"))
    per = s.groupBy("cohort").agg(F.map_from_entries(F.collect_list(F.struct("marker", "x"))).alias("have"))
    slots = per.join(vocabulary).select("cohort", "have", F.posexplode("slots").alias("idx", "marker"))
    x = F.try_element_at("have", "marker")
    return slots.select("cohort", F.col("idx").cast("long").alias("idx"), fixed(F.coalesce(x, F.lit(0.0)), 6).alias("x"), x.isNotNull().alias("present"))


@register("""WITH f AS (SELECT source, min(doc_id) AS first FROM documents WHERE source IS NOT NULL GROUP BY 1) SELECT source, dense_rank() OVER (ORDER BY first) - 1 AS code FROM f""")
def factorise(spark: SparkSession, d: str) -> DataFrame:
    """Codes by first appearance."""
    f = table(spark, d, "documents").where("source is not null").groupBy("source").agg(F.min("doc_id").alias("first"))
    return schema.dense_ids(f, "first", "code").select("source", "code")


@register("""WITH v AS (SELECT cohort, count(DISTINCT triple) AS n FROM marker_registry WHERE triple <> '' GROUP BY 1), a AS (SELECT DISTINCT triple FROM marker_registry WHERE triple <> '')
SELECT triple, row_number() OVER (ORDER BY triple) - 1 AS idx FROM a""")
def vocab_index(spark: SparkSession, d: str) -> DataFrame:
    """Sorted distinct triples and their index, numbered in shares."""
    triples = table(spark, d, "marker_registry").where("triple <> ''").select("triple").distinct()
    return schema.dense_ids(triples, "triple", "idx").select("triple", "idx")


@register("""WITH old AS (SELECT triple, row_number() OVER (ORDER BY triple) - 1 AS i FROM (SELECT DISTINCT triple FROM marker_registry WHERE triple <> '' AND cohort <> 'UMBRA')),
new AS (SELECT triple, row_number() OVER (ORDER BY triple) - 1 AS i FROM (SELECT DISTINCT triple FROM marker_registry WHERE triple <> ''))
SELECT triple, old.i AS frozen, new.i AS rebuilt, CASE WHEN old.i IS NULL THEN 'added' WHEN new.i IS NULL THEN 'lost' WHEN old.i = new.i THEN 'kept' ELSE 'moved' END AS state FROM old FULL JOIN new USING (triple)""")
def vocab_freeze(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary frozen by writing it before a cohort came, against the one built anew: what would be misaligned."""
    named = table(spark, d, "marker_registry").where("triple <> ''").select("triple", "cohort")
    frozen = cut(schema.dense_ids(named.where("cohort <> 'UMBRA'").select("triple").distinct(), "triple", "frozen"), "vocabulary")
    return schema.misaligned(frozen, schema.dense_ids(named.select("triple").distinct(), "triple", "rebuilt"), "triple")


@register("""WITH p AS (SELECT DISTINCT patient_id, image_id FROM cells WHERE patient_id IS NOT NULL AND image_id IS NOT NULL),
k AS (SELECT patient_id FROM p GROUP BY 1 HAVING count(*) >= 2) SELECT p.patient_id, count(*) AS n_slides FROM p JOIN k USING (patient_id) GROUP BY 1""")
def nested_domain(spark: SparkSession, d: str) -> DataFrame:
    """Slides whose patient has another slide."""
    p = table(spark, d, "cells").where("patient_id is not null and image_id is not null").select("patient_id", "image_id").distinct()
    return p.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n_slides")).where("n_slides >= 2")


@register(f"WITH {M} SELECT cohort, count(*) AS n FROM m WHERE cohort NOT IN ('UMBRA') GROUP BY 1")
def subset_cohorts(spark: SparkSession, d: str) -> DataFrame:
    """The table without the held-out cohort."""
    return standard_cells(spark, d).where(~F.col("cohort").isin("UMBRA")).groupBy("cohort").agg(F.count(F.lit(1)).alias("n"))


def _tight(pattern: str, n: int) -> str:
    return f"regexp_extract(t, '{pattern}', {n})"


@register(f"""SELECT registry_id, trim(regexp_replace(trim(split_part(split_part(translate(raw_column, chr(9) || chr(10) || chr(13), '   '), ':', 1), ' - ', 1)), '{names.CYCLE}', '')) AS stripped,
upper(regexp_replace(raw_column, '[^A-Za-z0-9]', '', 'g')) AS key FROM marker_registry WHERE raw_column IS NOT NULL""")
def strip_name(spark: SparkSession, d: str) -> DataFrame:
    """H1, H3: vendor decoration taken off, and the key of letters and digits."""
    raw = F.col("raw_column")
    return table(spark, d, "marker_registry").where("raw_column is not null").select("registry_id", names.bare(raw).alias("stripped"), names.ascii_key(raw).alias("key"))


@register(f"""WITH r AS (SELECT registry_id, trim(stripped) AS name, translate(trim(stripped), '-_ ', '') AS t FROM marker_registry WHERE stripped IS NOT NULL)
SELECT registry_id, CASE WHEN regexp_matches(t, '{names.MARK}') THEN upper({_tight(names.MARK, 1)}) WHEN regexp_matches(t, '{names.ISOFORM}') THEN upper({_tight(names.ISOFORM, 1)})
WHEN regexp_matches(t, '{names.PHOSPHO}') THEN {_tight(names.PHOSPHO, 2)} WHEN upper(t) = 'S6' THEN 'RPS6' ELSE name END AS core,
CASE WHEN regexp_matches(t, '{names.MARK}') THEN upper({_tight(names.MARK, 2)}) || lower({_tight(names.MARK, 3)}) WHEN regexp_matches(t, '{names.ISOFORM}') THEN upper({_tight(names.ISOFORM, 2)}) ELSE 'pan' END AS epitope,
CASE WHEN NOT regexp_matches(t, '{names.MARK}') AND NOT regexp_matches(t, '{names.ISOFORM}') AND regexp_matches(t, '{names.PHOSPHO}') THEN 'phospho' ELSE 'none' END AS modification FROM r""")
def split_name(spark: SparkSession, d: str) -> DataFrame:
    """H2: core, epitope and modification of a name: histone marks, isoforms, phosphorylated proteins, short names."""
    return table(spark, d, "marker_registry").where("stripped is not null").select("registry_id", names.form(F.trim("stripped")).alias("f")).select("registry_id", "f.*")


@register("""SELECT DISTINCT registry_id, variant FROM (SELECT registry_id, unnest([core, replace(core, '-', ''), replace(core, ' ', ''), replace(core, '_', ''), upper(core)]) AS variant FROM marker_registry WHERE core <> '')""")
def spelling_variants(spark: SparkSession, d: str) -> DataFrame:
    """H4: spellings of a name as a set."""
    return table(spark, d, "marker_registry").where("core <> ''").select("registry_id", F.explode(names.variants(F.col("core"))).alias("variant"))


@register("""SELECT event_id, json_extract(props, '$.k')::BIGINT AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS other FROM events""")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    """H8: JSON paths with defaults."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.coalesce(F.get_json_object("props", "$.missing"), F.lit("none")).alias("other"))


@register(f"""WITH {M} SELECT cohort, round(avg(exp(-conf)), 6) AS e, round(avg(sqrt(abs(area_px2))), 5) AS s, round(avg(ln(greatest(area_px2, 1))), 6) AS l, round(avg(log2(greatest(area_px2, 1))), 6) AS l2,
round(avg(log10(greatest(area_px2, 1))), 6) AS l10, round(avg(least(1, greatest(0, area_px2 / 1000))), 6) AS c FROM m GROUP BY 1""")
def numeric_functions(spark: SparkSession, d: str) -> DataFrame:
    """H9: exponentials, roots, logarithms, clipping."""
    a = F.col("area_px2")
    one = F.coalesce(F.greatest(a, F.lit(1.0)), F.lit(1.0))
    return standard_cells(spark, d).groupBy("cohort").agg(
        fixed(F.avg(F.exp(-F.col("conf"))), 6).alias("e"), fixed(F.avg(F.sqrt(F.abs(a))), 5).alias("s"), fixed(F.avg(F.ln(one)), 6).alias("l"),
        fixed(F.avg(F.log2(one)), 6).alias("l2"), fixed(F.avg(F.log10(one)), 6).alias("l10"), fixed(F.avg(F.least(F.lit(1.0), F.coalesce(F.greatest(F.lit(0.0), a / 1000), F.lit(0.0)))), 6).alias("c"),
    )


@register("""WITH e AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, i, avg(x) AS c FROM e GROUP BY 1, 2)
SELECT vec_id, c.label AS prototype, round(sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 6) AS cosine, round(sqrt(sum((x - c) * (x - c))), 5) AS distance FROM e JOIN c USING (i) GROUP BY 1, 2""")
def vector_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Cosine and distance of every vector to every class centre; arrays stay arrays."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.lit(0).alias("all"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    centres = vectors.centroids(e, "label", "x").select(F.lit(0).alias("all"), F.col("label").alias("prototype"), "centroid")
    return e.join(broadcast_up_to(centres), "all").select("vec_id", "prototype", fixed(vectors.cosine("x", "centroid"), 6).alias("cosine"), fixed(vectors.distance("x", "centroid"), 5).alias("distance"))


@register("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE / 0.5 AS z FROM embeddings) SELECT vec_id, round(max(exp(z - m)) / sum(exp(z - m)), 6) AS top FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM e) GROUP BY 1""")
def softmax_top(spark: SparkSession, d: str) -> DataFrame:
    """Greatest softmax probability at a temperature of 0.5."""
    return table(spark, d, "embeddings").select("vec_id", fixed(vectors.softmax_top(F.transform("embedding", lambda x: x.cast("double")), 0.5), 6).alias("top"))


@register("SELECT vec_id, round(embedding[1]::DOUBLE + 0.3 * tanh(0.5 * embedding[2]::DOUBLE + 0.1), 6) AS corrected FROM embeddings")
def bounded_affine(spark: SparkSession, d: str) -> DataFrame:
    """An affine correction bounded by 0.3."""
    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, d, "embeddings").select("vec_id", fixed(vectors.bounded_correction(a, b, 0.5, 0.1, 0.3), 6).alias("corrected"))


@register("SELECT count(*) AS n, regexp_replace(text, '[0-9]+$', '') AS stem FROM (SELECT replace(symbol, '_PAN', '') AS text FROM marker_reference) GROUP BY 2")
def trailing_strip(spark: SparkSession, d: str) -> DataFrame:
    """H6: replacement, and characters taken off the end."""
    text = F.regexp_replace(F.replace("symbol", F.lit("_PAN"), F.lit("")), "[0-9]+$", "")
    return table(spark, d, "marker_reference").groupBy(text.alias("stem")).agg(F.count(F.lit(1)).alias("n"))
