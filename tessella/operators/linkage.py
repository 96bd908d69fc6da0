"""Average-linkage clustering of labels and what is decided on it.

A few hundred labels remain of any number of rows; a table of their distances is one group for one task, and more than
MOST_NODES of them are refused rather than collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_NODES = 2_000
FAR = 5.0


def matrix(frame: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Node names in order and their distances, FAR where a pair is missing."""
    nodes = sorted({*frame["a"], *frame["b"]})
    if len(nodes) > MOST_NODES:
        raise ValueError(f"{len(nodes)} labels; at most {MOST_NODES} are clustered")
    at = {n: i for i, n in enumerate(nodes)}
    d = np.full((len(nodes), len(nodes)), FAR)
    i, j = frame["a"].map(at).to_numpy(), frame["b"].map(at).to_numpy()
    d[i, j] = d[j, i] = frame["distance"].to_numpy()
    np.fill_diagonal(d, 0)
    return nodes, d


def average_linkage(d: np.ndarray, cuts: list[float]) -> dict[float, np.ndarray]:
    """Cluster numbers (by first member) at each cut: the closest two clusters merge, the first of equals, by mean distance."""
    n = len(d)
    d, size = np.round(d.astype(float), 12), np.ones(n)
    np.fill_diagonal(d, np.inf)
    member, out, left = np.arange(n), {}, sorted(cuts)
    while left:
        i, j = divmod(int(d.argmin()), n) if n > 1 else (0, 0)
        low = d[i, j] if n > 1 else np.inf
        while left and low > left[0]:
            out[left.pop(0)] = np.unique(member, return_inverse=True)[1]
        if not left:
            break
        i, j = min(i, j), max(i, j)
        merged = np.round((d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j]), 12)
        d[i], d[:, i] = merged, merged
        d[i, i], d[j], d[:, j] = np.inf, np.inf, np.inf
        size[i] += size[j]
        member[member == j] = i
    return out


def _ari(a: np.ndarray, b: np.ndarray) -> float:
    t = pd.crosstab(a, b).to_numpy(float)
    c2 = lambda x: (x * (x - 1) / 2).sum()
    i, j, c = c2(t.sum(1)), c2(t.sum(0)), c2(t.sum())
    room = (i + j) / 2 - (i * j / c if c else 0)
    return float((c2(t) - i * j / c) / room) if c and room else 0.0


def _pairs(dist: DataFrame) -> DataFrame:
    return dist.select(F.concat_ws("|", "cohort_a", "label_a").alias("a"), F.concat_ws("|", "cohort_b", "label_b").alias("b"), "distance")


def clusters(dist: DataFrame, cut: float) -> DataFrame:
    """``cohort``, ``label``, ``cluster`` at one cut."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, d = matrix(frame)
        found = average_linkage(d, [cut])[cut]
        return pd.DataFrame([(*n.split("|", 1), int(c)) for n, c in zip(nodes, found)], columns=["cohort", "label", "cluster"])

    return _pairs(dist).groupBy().applyInPandas(run, "cohort string, label string, cluster int")


def sweep(dist: DataFrame, cuts: list[float]) -> DataFrame:
    """For each cut: clusters, singles, agreement with the cohorts, and stability when each cohort is left out."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, d = matrix(frame)
        cohort = np.array([n.split("|", 1)[0] for n in nodes])
        whole = average_linkage(d, cuts)
        parts = {c: average_linkage(d[np.ix_(cohort != c, cohort != c)], cuts) for c in sorted(set(cohort)) if (cohort != c).sum() > 1}
        rows = []
        for cut in cuts:
            m = whole[cut]
            stable = [_ari(m[cohort != c], p[cut]) for c, p in parts.items()]
            rows.append((cut, int(m.max() + 1), int((np.bincount(m) == 1).sum()), round(_ari(m, cohort), 6), round(float(np.mean(stable)), 6) if stable else None))
        return pd.DataFrame(rows, columns=["cut", "n_clusters", "n_single", "cohort_ari", "stability"])

    return _pairs(dist).groupBy().applyInPandas(run, "cut double, n_clusters int, n_single int, cohort_ari double, stability double")


def refine(dist: DataFrame, cut: float, least: int = 3) -> DataFrame:
    """Binary splits of the clusters at ``cut``, with the reason why each is kept or not: size and two cohorts on each side."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, d = matrix(frame)
        cohort = np.array([n.split("|", 1)[0] for n in nodes])
        m = average_linkage(d, [cut])[cut]
        stack, rows = [np.flatnonzero(m == c) for c in range(m.max() + 1)], []
        while stack:
            part = stack.pop()
            if len(part) < 2:
                continue
            sub = d[np.ix_(part, part)]
            heights = [h for h in np.unique(sub) if h < FAR]
            two = next((p for h in reversed(heights) if (p := average_linkage(sub, [h * 0.999999])[h * 0.999999]).max() == 1), None)
            if two is None:
                continue
            sides = [part[two == s] for s in (0, 1)]
            small, few = min(map(len, sides)) < least, min(len(set(cohort[s])) for s in sides) < 2
            rows.append((nodes[part[0]], len(part), len(sides[0]), len(sides[1]), "too small" if small else "one cohort" if few else "split"))
            if not small and not few:
                stack += sides
        return pd.DataFrame(rows, columns=["first_label", "size", "left", "right", "decision"])

    return _pairs(dist).groupBy().applyInPandas(run, "first_label string, size int, left int, right int, decision string")


def matched_cut(dist: DataFrame, cuts: list[float], wanted: int) -> DataFrame:
    """The first cut whose number of clusters comes nearest to ``wanted``."""
    s = sweep(dist, cuts).withColumn("gap", F.abs(F.col("n_clusters") - wanted))
    return s.orderBy("gap", "cut").limit(1).select("cut", "n_clusters", "gap")
