"""Problem 7: find passages of held-out items in a corpus, whole, partial or edited.

1. Seeds.  Every run of ``seed`` words of an item is a seed.  A bit table of all seeds, of bounded size however many
   items there are, goes to the workers.
2. Scan.  Every text is reduced to words; its runs of ``seed`` words that the bit table knows are hits, and hits lying
   close together, with some words around them, form a passage.  Only passages leave the scan, in one pass.
3. Rarity.  Hits are counted over the corpus, and of every window of ``window`` consecutive item words the rarest seed
   is chosen.  Each window keeps a seed, so a text that repeats a whole window is always met.  Seeds that stand in one
   item alone are chosen as well, for copies whose edits leave no whole window.
4. Join.  Passages and items that share a chosen seed become candidates, equal passages once; a hit that the bit table
   took for a seed by mistake joins nothing.
5. Alignment.  Smith-Waterman over words scores each candidate and finds its longest run of equal words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.plans.joins import skew_join
from tessella.plans.materialize import cut, task_count

from .texwords import tex_words, word_runs

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the table for each seed, its least and greatest size (32 MB), and places tested for a seed.
BITS_EACH, LEAST_BITS, MOST_BITS, PROBES = 32, 1 << 16, 1 << 28, 8
#: Words whose hashes a worker keeps before it starts anew; pairs aligned at once.
MEMO, TOGETHER = 1_000_000, 32
#: What shorter sequences are filled up with; no word has such a hash, and the two differ.
NO_ITEM_WORD, NO_TEXT_WORD = 0, 1


class _Hashes(dict):
    """Word to its 64-bit hash."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word) | 2
        return value


def _hashed(words: list[str], known: _Hashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _rolling(words: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of every run of ``n`` words; equal runs have equal hashes."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for j in range(n):
        out = out * _BASE + words[j : len(words) - n + 1 + j]
    out ^= out >> np.uint64(31)
    return out * _BASE


def _place(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    """Where the table is tested for each hash, for the ``probe``-th time."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return (hashes + np.uint64(probe) * step) & np.uint64(bits - 1)


def _items(seed: int):
    """Function for mapInPandas: each item's words and seeds as hashes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for frame in frames:
            rows = []
            for item, no, text in frame.itertuples(index=False, name=None):
                words = word_runs(text.lower())
                hashes = _hashed(words, known)
                seeds = _rolling(hashes, seed)
                if len(seeds):
                    rows.append((item, no, len(words), max(map(len, words)), hashes.tobytes(), seeds.view(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["item_id", "item_no", "n_words", "longest", "words", "grams"])

    return run


def _seed_table(items: DataFrame, seeds: int) -> np.ndarray:
    """The bit table of all seeds: at most MOST_BITS bits, put together from the tasks' parts."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * seeds - 1).bit_length()))

    def parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            hashes = np.concatenate([np.empty(0, np.int64), *frame["grams"]]).astype(np.int64).view(np.uint64)
            places = np.unique(np.concatenate([_place(hashes, k, bits) for k in range(PROBES)]))
            word, first = np.unique(places >> np.uint64(6), return_index=True)
            value = np.bitwise_or.reduceat(np.uint64(1) << (places & np.uint64(63)), first) if len(first) else np.empty(0, np.uint64)
            yield pd.DataFrame({"word": word.astype(np.int64), "value": value.view(np.int64)})

    got = items.select("grams").mapInPandas(parts, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    table = np.zeros(bits >> 6, np.int64)
    table[got["word"].to_numpy()] = got["value"].to_numpy()
    return table.view(np.uint64)


def _known(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of the hashes that the table knows."""
    at = np.arange(len(hashes))
    for k in range(PROBES):
        place = _place(hashes[at], k, len(table) << 6)
        at = at[(table[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) == 1]
        if not len(at):
            break
    return at


def _scan(shared, seed: int, gap: int, margin: int, longest: int, keep: int):
    """Function for mapInPandas: passages of each text around its hits.

    A passage of over six times the longest item's words goes on as overlapping windows; every alignment with an item
    lies whole in one of them, since it takes at most three times the item's words.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, known = shared.value, _Hashes()
        size, step = 6 * longest + 2 * margin, 3 * longest + margin
        for frame in frames:
            rows = []
            for doc, text in frame.itertuples(index=False, name=None):
                words = _hashed(tex_words(text, keep), known)
                hashes = _rolling(words, seed)
                at = _known(hashes, table)
                if not len(at):
                    continue
                for part in np.split(at, np.flatnonzero(np.diff(at) > gap) + 1):
                    first, last = max(0, part[0] - margin), min(len(words), part[-1] + seed + margin)
                    for start in range(first, max(first + 1, last - size + step), step):
                        end = min(last, start + size)
                        inside = part[(part >= start) & (part + seed <= end)]
                        if len(inside):
                            passage = words[start:end].tobytes()
                            rows.append((doc, hashlib.md5(passage).hexdigest(), passage, np.unique(hashes[inside]).view(np.int64).tolist()))
            yield pd.DataFrame(rows, columns=["doc_id", "passage_no", "passage", "seeds"])

    return run


def align(items: list[np.ndarray], passages: list[np.ndarray], match: int = 2, other: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its passage: score, equal words on its path, longest run of equal words anywhere.

    Smith-Waterman with ``match`` for equal words and ``other`` for a different, missing or additional one, for all
    pairs at once: row by row of the items, over the whole width of the passages.
    """
    n, width = len(items), max(map(len, passages))
    left = np.full((n, max(map(len, items))), NO_ITEM_WORD, np.uint64)
    right = np.full((n, width), NO_TEXT_WORD, np.uint64)
    for k, (i, p) in enumerate(zip(items, passages)):
        left[k, : len(i)], right[k, : len(p)] = i, p
    score, equal_on, run = (np.zeros((n, width + 1), np.int32) for _ in range(3))
    at, steps = np.arange(width + 1, dtype=np.int32), np.arange(width + 1, dtype=np.int32) * -other
    best, best_equal, longest = (np.zeros(n, np.int32) for _ in range(3))
    every = np.arange(n)
    row, equal = np.zeros((n, width + 1), np.int32), np.zeros((n, width + 1), np.int32)
    for j in range(left.shape[1]):
        same = right == left[:, j, None]
        run[:, 1:] = (run[:, :-1] + 1) * same
        np.maximum(longest, run.max(axis=1), out=longest)
        diagonal = score[:, :-1] + np.where(same, match, other).astype(np.int32)
        up = score[:, 1:] + other
        row[:, 1:] = np.maximum(np.maximum(diagonal, up), 0)
        equal[:, 1:] = np.where(diagonal >= up, equal_on[:, :-1] + same, equal_on[:, 1:]) * (row[:, 1:] > 0)
        # a gap along the passage: the best former cell of this row, less one step for each word between
        lifted = row + steps
        top = np.maximum.accumulate(lifted, axis=1)
        source = np.maximum.accumulate(np.where(lifted == top, at, 0), axis=1)
        score = np.maximum(top - steps, 0)
        equal_on = np.take_along_axis(equal, source, axis=1) * (score > 0)
        peak = score.argmax(axis=1)
        better = score[every, peak] > best
        best[better] = score[every, peak][better]
        best_equal[better] = equal_on[every, peak][better]
    return best, best_equal, longest


def _aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        items = [np.frombuffer(b, np.uint64) for b in frame["words"]]
        passages = [np.frombuffer(b, np.uint64) for b in frame["passage"]]
        out = np.zeros((3, len(frame)), np.int32)
        # pairs of like size together, so that little is filled up
        order = np.lexsort(([len(i) for i in items], [len(p) for p in passages]))
        for k in range(0, len(order), TOGETHER):
            some = order[k : k + TOGETHER]
            out[:, some] = align([items[i] for i in some], [passages[i] for i in some])
        got = pd.DataFrame(dict(zip(("score", "equal_words", "longest_run"), out)))
        yield pd.concat([frame[["passage_no", "item_no"]].reset_index(drop=True), got], axis=1)


def leaks(
    corpus: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    seed: int = 6,
    window: int = 12,
    gap: int = 40,
    margin: int = 40,
) -> DataFrame:
    """One row for each pair of a corpus text and an item of which it holds a passage.

    Columns: the two keys, ``score`` (best local alignment, 2 for an equal word and -1 for a differing, missing or
    additional one), ``equal_words`` on that alignment, ``longest_run`` of equal consecutive words, ``item_words``
    and ``covered`` (the greatest share of an item's words).  The corpus is read once, whatever the number of items; no
    text passes through the driver, only the bit table of seeds (at most 32 MB) does.  NULL and empty texts, rows with
    a NULL key and items of fewer than ``seed`` words give no row; repeated rows of one key count once, and different
    texts of one key all count; other columns aren't read.
    """
    spark = corpus.sparkSession
    texts = corpus.select(corpus[key].alias("doc_id"), corpus[text].cast("string").alias("text")).where("doc_id is not null and text is not null")
    held = items.select(items[item_key].alias("item_id"), items[item_text].cast("string").alias("text")).where("item_id is not null and text is not null")
    kinds = {k: f.schema[k].dataType.simpleString() for f, k in ((texts, "doc_id"), (held, "item_id"))}
    numbered = held.distinct().select("item_id", F.md5(F.concat_ws("\x00", F.col("item_id").cast("string"), "text")).alias("item_no"), "text")
    known = cut(numbered.mapInPandas(_items(seed), f"item_id {kinds['item_id']}, item_no string, n_words int, longest int, words binary, grams array<long>"), "items")
    sizes = known.agg(F.max("n_words").alias("words"), F.max("longest").alias("letters"), F.sum(F.size("grams")).alias("seeds")).first()
    longest = sizes["words"] or 1
    table = spark.sparkContext.broadcast(_seed_table(known, sizes["seeds"] or 1))
    run = _scan(table, seed, gap, margin, longest, max(3 * longest, sizes["letters"] or 1))
    scanned = cut(texts.mapInPandas(run, f"doc_id {kinds['doc_id']}, passage_no string, passage binary, seeds array<long>"), "passages")
    count = scanned.select("doc_id", F.explode("seeds").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    ranked = known.select("item_no", F.posexplode("grams").alias("at", "gram")).join(count, "gram", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    choice = F.min(F.struct("n", "gram")).over(Window.partitionBy("item_no").orderBy("at").rowsBetween(0, max(0, window - seed)))
    rarest = ranked.withColumn("best", choice).where("best.n > 0").select("item_no", F.col("best.gram").alias("gram"))
    # what stands in one item alone points to it even where no whole window was kept
    own = ranked.where("n > 0").groupBy("gram").agg(F.min("item_no").alias("item_no"), F.max("item_no").alias("other")).where("item_no = other")
    chosen = cut(rarest.unionByName(own.select("item_no", "gram")).distinct(), "chosen")
    # equal passages are aligned once
    passages = scanned.dropDuplicates(["passage_no"]).select("passage_no", "passage", "seeds")
    seeds_of = scanned.select("passage_no", F.explode("seeds").alias("gram")).distinct()
    candidates = cut(skew_join(seeds_of, chosen, ["gram"], F.col("passage_no")).select("passage_no", "item_no").distinct(), "candidates")
    pairs = candidates.join(passages.select("passage_no", "passage"), "passage_no").join(known.select("item_no", "words"), "item_no")
    # dealt out one by one: few bytes and much work, so neither bytes nor keys should set the tasks
    aligned = pairs.repartition(task_count(spark)).mapInPandas(_aligned, "passage_no string, item_no string, score int, equal_words int, longest_run int")
    aligned = aligned.join(known.select("item_no", "item_id", F.col("n_words").alias("item_words")), "item_no").drop("item_no")
    holds = skew_join(scanned.select("doc_id", "passage_no").distinct(), cut(aligned, "aligned"), ["passage_no"], F.col("doc_id"))
    top = F.max(F.struct(F.col("equal_words") / F.col("item_words"), "item_words"))
    return (
        holds.groupBy("doc_id", "item_id")
        .agg(
            F.max("score").alias("score"), F.max("equal_words").alias("equal_words"), F.max("longest_run").alias("longest_run"),
            top.alias("top"),
        )
        .select("doc_id", "item_id", "score", "equal_words", "longest_run", F.col("top.item_words").alias("item_words"), F.col("top.col1").alias("covered"))
        .withColumnsRenamed({"doc_id": key, "item_id": item_key})
    )
