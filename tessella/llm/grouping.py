"""Problem 4: splits that keep related records together.

Ties are edges between slides and patients.  Connected groups come from union-find in levels: each task joins its
share of the edges into a local forest; only nodes in which the forests of several tasks meet go up to the next level,
until one task can hold what is left.  Groups then go, largest first, to the split that lies furthest below its target
in the group's cohorts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.cells import no_patient
from tessella.plans.joins import skew_join
from tessella.plans.materialize import cut

SPLITS = {"train": 0.68, "validation": 0.12, "test": 0.20}


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the task's edges: every node with the smallest node of its local tree."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for frame in frames:
        for a, b in frame.itertuples(index=False, name=None):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for at in range(0, len(nodes), 10_000):
        part = nodes[at : at + 10_000]
        yield pd.DataFrame({"node": part, "root": [find(x) for x in part]})


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _shares(level: DataFrame, n: int, edges_per_task: int) -> DataFrame:
    """The ``n`` edges in shares of about half of ``edges_per_task``; neighbours in the order of nodes lie together, and
    a node with more edges than that is spread over several shares."""
    return level.repartitionByRange(2 * -(-n // edges_per_task), "a", "b")


def _forests(level: DataFrame, n: int, edges_per_task: int) -> tuple[DataFrame, DataFrame]:
    """One level of local forests: the nodes that are settled by one share alone, with their root, and the edges that
    go up: from each node that several shares hold to its root in each of them, never more than came in."""
    local = cut(_shares(level, n, edges_per_task).mapInPandas(_forest, "node string, root string"), "forest")
    met = local.withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("node"))).where("node <> root")
    return met.where("times = 1").select("node", "root"), met.where("times > 1").select(*_ordered(F.col("node"), F.col("root"))).distinct()


def _contracted(level: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Every node whose coin fell to tails joins its smallest neighbour with heads: these pairs, and the edges left
    between what remains.  In expectation at least a quarter of the nodes goes, whatever the graph's form."""
    heads = {c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0 for c in ("a", "b")}
    both = level.unionByName(level.select(F.col("b").alias("a"), F.col("a").alias("b")))
    hooks = cut(both.where(~heads["a"] & heads["b"]).groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node"), "hooks")
    moved = level
    for end, other in (("a", "b"), ("b", "a")):
        side = hooks.select(F.col("node").alias(end), F.col("root").alias("_to"))
        moved = skew_join(moved, side, [end], F.col(other), "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
    return hooks, cut(moved.where("a <> b").select(*_ordered(F.col("a"), F.col("b"))).distinct(), "edges")


def components(edges: DataFrame, edges_per_task: int = 500_000) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for every node of ``edges`` (strings ``a``, ``b``).

    While there are more than ``edges_per_task`` edges, each task joins a share of about half as many into a local
    forest, and what several shares hold goes up to the next level; where that leaves too much, neighbours are
    contracted as well, so that levels shrink for graphs of any form and never grow.  The last level is joined in one
    task.  No link is collected.  NULL ends drop the edge, loops and repeated edges do no harm, no edges give no rows.
    """
    whole = cut(edges.where("a is not null and b is not null").select(*_ordered(F.col("a"), F.col("b"))).distinct(), "edges")
    level, steps, turn = whole.where("a <> b"), [], 0
    while (n := level.count()) > edges_per_task:
        settled, up = _forests(level, n, edges_per_task)
        level = cut(up, "edges")
        steps.append(settled)
        if level.count() > edges_per_task:
            hooks, level = _contracted(level, turn)
            steps.append(hooks)
        turn += 1
    out = cut(level.repartition(1).mapInPandas(_forest, "node string, root string"), "forest")
    for lower in reversed(steps):
        upper = out.select(F.col("node").alias("root"), F.col("root").alias("_top"))
        out = cut(lower.join(upper, "root", "left").select("node", F.coalesce("_top", "root").alias("root")).unionByName(out), "roots")
    nodes = whole.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    found = nodes.join(out, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    if not steps:
        return found
    least = found.groupBy("root").agg(F.min("node").alias("least"))
    return found.join(least, "root").select("node", F.col("least").alias("root"))


def slide_patients(cells: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Distinct slides with the patient ids (trimmed, upper case) that tie; ids that say nothing are left out."""
    pairs = cells.where("image_id is not null and patient_id is not null").select("image_id", F.upper(F.trim("patient_id")).alias("patient")).distinct()
    named = pairs.where(~no_patient(F.col("patient"))).withColumn("prefix", F.substring_index("patient", "|", 1))
    patterns = cohorts.select(F.upper(F.trim("cohort")).alias("prefix"), "patient_pattern").where("prefix is not null and patient_pattern is not null")
    matches = F.regexp("patient", F.concat(F.lit(r"(?i)\A(?:"), "patient_pattern", F.lit(r")\z")))
    return named.join(patterns, "prefix").where(matches).select("image_id", "patient").distinct()


def tied_slides(cells: DataFrame, cohorts: DataFrame, edges_per_task: int = 500_000) -> DataFrame:
    """``image_id`` and ``group_id`` (the group's smallest slide) of every slide, tied or alone."""
    pairs = slide_patients(cells, cohorts)
    slide, patient = F.concat(F.lit("s:"), "image_id"), F.concat(F.lit("p:"), "patient")
    found = components(pairs.select(slide.alias("a"), patient.alias("b")), edges_per_task)
    roots = found.where("node like 's:%'").select(F.substring("node", 3, 1 << 30).alias("image_id"), "root")
    smallest = roots.groupBy("root").agg(F.min("image_id").alias("group_id"))
    tied = roots.join(smallest, "root").select("image_id", "group_id")
    every = cells.where("image_id is not null").select("image_id").distinct()
    return every.join(tied, "image_id", "left").select("image_id", F.coalesce("group_id", "image_id").alias("group_id"))


def shared_out(lead: list[float], step: float, n: int) -> list[int]:
    """How many of ``n`` equal groups each split takes, if each goes to the split with the greatest lead, the first of
    equals, and lowers it by ``step``."""
    high = sorted(lead, reverse=True)
    for k in range(1, len(high) + 1):  # the level that the leads would sink to if groups could be parted
        level = (sum(high[:k]) - step * n) / k
        if k == len(high) or high[k] <= level:
            break
    counts = [max(0, int((x - level) // step) - 1) for x in lead]
    for _ in range(n - sum(counts)):  # the last few one by one
        best = max(range(len(lead)), key=lambda s: lead[s] - counts[s] * step)
        counts[best] += 1
    return counts


def _greedy(shares: dict[str, float], totals: dict[str, int]):
    """Function for mapInPandas over the profiles, largest first: one interval of group ranks for each split."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        below = {s: {c: share * n for c, n in totals.items()} for s, share in shares.items()}
        for frame in frames:
            rows = []
            for text, n in frame.itertuples(index=False, name=None):
                sizes = {p.rpartition("=")[0]: int(p.rpartition("=")[2]) for p in text.split("\x1f")}
                lead = [sum(short[c] * size for c, size in sizes.items()) for short in below.values()]
                at = 0
                for (split, short), k in zip(below.items(), shared_out(lead, float(sum(x * x for x in sizes.values())), int(n))):
                    for c, size in sizes.items():
                        short[c] -= size * k
                    if k:
                        rows.append((text, at, at + k - 1, split))
                        at += k
            yield pd.DataFrame(rows, columns=["profile", "from_rank", "to_rank", "split"])

    return run


def assign_splits(slides: DataFrame, shares: dict[str, float] | None = None, bucket_rows: int = 100_000) -> DataFrame:
    """``slides`` (``image_id``, ``group_id``, ``cohort``) with a ``split`` that all slides of a group share.

    Largest first, each group goes to the split that lies furthest below its target in the group's cohorts.  Groups with
    the same slides per cohort are interchangeable, so the choice is made for such profiles with their numbers, each
    at once, in a stream that holds the splits' targets only; each group then finds its split by its rank within its profile.
    """
    shares = shares or SPLITS
    sizes = slides.groupBy("group_id", F.coalesce("cohort", F.lit("")).alias("cohort")).agg(F.count(F.lit(1)).alias("n"))
    part = F.concat_ws("=", "cohort", F.col("n").cast("string"))
    groups = cut(sizes.groupBy("group_id").agg(F.array_join(F.array_sort(F.collect_list(part)), "\x1f").alias("profile"), F.sum("n").alias("size")), "groups")
    totals = {r["cohort"]: r["n"] for r in sizes.groupBy("cohort").agg(F.sum("n").alias("n")).collect()}
    profiles = groups.groupBy("profile", "size").agg(F.count(F.lit(1)).alias("n"))
    ordered = profiles.repartition(1).sortWithinPartitions(F.desc("size"), "profile").select("profile", "n")
    runs = cut(ordered.mapInPandas(_greedy(shares, totals), "profile string, from_rank long, to_rank long, split string"), "runs")
    buckets = max(1, -(-groups.count() // bucket_rows))
    bucketed = groups.drop("size").withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(buckets)))
    before = bucketed.groupBy("profile", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "before", F.sum("n").over(Window.partitionBy("profile").orderBy("bucket")) - F.col("n")
    ).drop("n")
    own = F.row_number().over(Window.partitionBy("profile", "bucket").orderBy("group_id")) - 1
    ranked = bucketed.withColumn("own", own).join(before, ["profile", "bucket"]).withColumn("rank", F.col("own") + F.col("before"))
    placed = skew_join(ranked, runs, ["profile"], F.col("group_id")).where("rank between from_rank and to_rank").select("group_id", "split")
    return slides.join(placed, "group_id")


def slide_splits(cells: DataFrame, cohorts: DataFrame, shares: dict[str, float] | None = None, edges_per_task: int = 500_000) -> DataFrame:
    """``image_id``, ``cohort``, ``group_id`` and ``split`` of every slide.

    A slide's cohort is the one (trimmed, upper case) of most of its rows, the alphabetically last of equals, NULL if
    none is named.  NULL slides don't count; patient ids that are NULL, stand-ins or not of their cohort's form tie
    nothing; repeated rows change nothing; other columns aren't read; an empty table gives no rows.
    """
    cohort = F.upper(F.trim("cohort"))
    rows = cells.where("image_id is not null").groupBy("image_id", cohort.alias("cohort")).agg(F.count(F.lit(1)).alias("n"))
    known = F.when(F.col("cohort").isNotNull(), F.struct("n", "cohort"))
    of_slide = rows.groupBy("image_id").agg(F.max(known)["cohort"].alias("cohort"))
    groups = tied_slides(cells, cohorts, edges_per_task)
    slides = cut(of_slide.join(groups, "image_id").select("image_id", "cohort", "group_id"), "slides")
    return assign_splits(slides, shares).select("image_id", "cohort", "group_id", "split")
