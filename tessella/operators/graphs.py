"""Directed graphs of labels and terms: reachability by repeated joining, contraction, ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.materialize import cut


def reachability(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Ordered pairs (``a``, ``b``) with a path from a to b; each round doubles the length of the paths found."""
    reach = cut(edges.where("a is not null and b is not null").select("a", "b").distinct(), "reach")
    n = reach.count()
    for _ in range(rounds):
        longer = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        reach = cut(reach.unionByName(longer).distinct(), "reach")
        more = reach.count()
        if more == n:
            break
        n = more
    return reach


def contract(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of the strongly connected components; what is left is acyclic."""
    reach = reachability(edges)
    mutual = reach.join(reach.select(F.col("a").alias("b"), F.col("b").alias("a")), ["a", "b"])
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct()
    least = mutual.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("other"))
    return nodes.join(least, "node", "left").select("node", F.least("node", F.coalesce("other", "node")).alias("component"))


def ancestors(is_a: DataFrame, depth: int = 40) -> DataFrame:
    """``term``, ``ancestor`` and the least number of steps (the term itself at 0) over edges ``child``, ``parent``.

    Terms that go on for ``depth`` steps or more are an error, and a cycle is such a one.
    """
    terms = is_a.select(F.explode(F.array("child", "parent")).alias("term")).distinct()
    parents = is_a.select(F.col("child").alias("ancestor"), "parent").distinct()
    found = level = cut(terms.select("term", F.col("term").alias("ancestor"), F.lit(0).alias("steps")), "ancestors")
    for step in range(1, depth):
        level = cut(level.join(parents, "ancestor").select("term", F.col("parent").alias("ancestor")).distinct().withColumn("steps", F.lit(step)), "ancestors")
        if level.isEmpty():
            break
        found = found.unionByName(level)
    else:
        raise ValueError(f"ancestors go on after {depth} steps")
    return found.groupBy("term", "ancestor").agg(F.min("steps").alias("steps"))


def nearest_in(closure: DataFrame, subset: DataFrame) -> DataFrame:
    """The nearest ancestor of each term that is in ``subset`` (column ``ancestor``): the smallest of equals, with a tie flag."""
    inside = closure.join(subset.select("ancestor").distinct(), "ancestor")
    w = Window.partitionBy("term")
    near = inside.withColumn("least", F.min("steps").over(w)).where("steps = least")
    return near.groupBy("term").agg(F.min("ancestor").alias("nearest"), F.first("least").alias("steps"), (F.count(F.lit(1)) > 1).alias("tie"))


def label_terms(labels: DataFrame) -> DataFrame:
    """is_a edges of labels by their words: a label is a kind of what remains without its first, or its last, word."""
    words = F.split("label", " ")
    n = F.size(words)
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.slice(words, i, k))))
    terms = labels.select(F.explode(spans).alias("t")).distinct().where(F.size("t") > 1)
    join = lambda x: F.array_join(x, " ")
    first = F.slice(F.col("t"), F.lit(2), F.size("t") - 1)
    last = F.slice(F.col("t"), F.lit(1), F.size("t") - 1)
    return terms.select(join(F.col("t")).alias("child"), F.explode(F.array(join(first), join(last))).alias("parent")).distinct()
