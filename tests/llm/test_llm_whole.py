"""Queries over whole tables against brute force, and what they leave in the session."""

from __future__ import annotations

import os
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from tessella.llm import bpe
from tessella.llm.queries import QUERIES
from tessella.llm.texwords import tex_words, word_runs

needs_vocabulary = pytest.mark.skipif(not os.path.exists(bpe.default_path()), reason="no vocabulary here")


@pytest.fixture(scope="module")
def texts(tiny):
    return {r["doc_id"]: r["text"] for r in pq.read_table(f"{tiny}/documents.parquet", columns=["doc_id", "text"]).to_pylist()}


def test_leaked_pairs(spark, tiny, texts):
    grams = defaultdict(set)
    for r in pq.read_table(f"{tiny}/eval_items.parquet", columns=["item_id", "text"]).to_pylist():
        words = word_runs((r["text"] or "").lower())
        for k in range(len(words) - 11):
            grams[tuple(words[k : k + 12])].add(r["item_id"])
    wanted = set()
    for doc, text in texts.items():
        words = tex_words(text)
        for k in range(len(words) - 11):
            wanted |= {(doc, i) for i in grams.get(tuple(words[k : k + 12]), ())}
    got = [tuple(r) for r in QUERIES["p7_found"](spark, tiny).collect()]
    assert len(wanted) > 3 and set(got) == wanted and len(got) == len(wanted)


@needs_vocabulary
def test_oversized_texts(spark, tiny, texts):
    encoder = bpe.encoder()
    over = {k for k, t in texts.items() if len(encoder.ids(t)) > 1024}
    assert len(over) > 3 and sorted(r.doc_id for r in QUERIES["p8_found"](spark, tiny).collect()) == sorted(over)


@needs_vocabulary
def test_ids_of_every_text(spark, tiny, texts):
    import base64
    import pathlib

    import tiktoken

    lines = pathlib.Path(bpe.default_path()).read_bytes().splitlines()
    public = tiktoken.Encoding("own", pat_str=bpe.SPLIT_PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in QUERIES["p6_ids"](spark, tiny).collect()}
    assert got == {k: public.encode_ordinary(t) if t else [] for k, t in texts.items()}


def test_percentiles_of_every_group(spark, tiny):
    fields = ["area_px2", "raw_dnx", "raw_velk2", "raw_orsa1", "raw_tamq4"]
    groups = defaultdict(list)
    for r in pq.read_table(f"{tiny}/cells.parquet").to_pylist():
        for f in fields:
            if r[f] is not None and np.isfinite(r[f]):
                groups["label", r["cohort"], r["native_label"], f].append(r[f])
                groups["image", r["image_id"], None, f].append(r[f])
    got = QUERIES["p5_percentiles"](spark, tiny).collect()
    assert {(r.kind, r.g1, r.g2, r.field) for r in got} == set(groups) and len(got) == 7 * len(groups)
    for r in got:
        v = np.sort(groups[r.kind, r.g1, r.g2, r.field])
        rank = max(1, int(np.ceil(r.percentile * len(v) / 100)))
        lo, hi = np.searchsorted(v, r.value, "left"), np.searchsorted(v, r.value, "right")
        assert lo < hi and max(0, lo + 1 - rank, rank - hi) <= 0.005 * len(v)


def test_no_setting_is_left_behind(spark, tiny):
    before = {k: v for k, v in spark.sparkContext._jvm.scala.jdk.CollectionConverters.MapHasAsJava(spark._jsparkSession.conf().getAll()).asJava().items()}
    for name in ("p6_ids", "p5_percentiles", "p7_found", "p8_found"):
        QUERIES[name](spark, tiny)
    after = {k: v for k, v in spark.sparkContext._jvm.scala.jdk.CollectionConverters.MapHasAsJava(spark._jsparkSession.conf().getAll()).asJava().items()}
    assert after == before


def test_edited_copies_are_met(spark, tiny):
    import random

    items = {r["item_id"]: word_runs((r["text"] or "").lower()) for r in pq.read_table(f"{tiny}/eval_items.parquet", columns=["item_id", "text"]).to_pylist()}
    r, docs, copies = random.Random(2), [], defaultdict(set)
    for rate in (0.05, 0.1, 0.15):
        for item, words in items.items():
            edited = []
            for w in words:
                x = r.random()
                if x < rate:  # a word is lost, another one comes, or both
                    edited += r.choice([[], ["other"], [w, "more"]])
                else:
                    edited.append(w)
            copies[rate].add((len(docs), item))
            docs.append((len(docs), "An article. " + " ".join(edited) + r" \section{End}"))
    from tessella.llm.leakage import leaks

    corpus = spark.createDataFrame(docs, "doc_id long, text string")
    known = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in leaks(corpus, known).where("longest_run >= 12 or (score >= 16 and covered >= 0.1)").collect()}
    recall = {rate: len(pairs & found) / len(pairs) for rate, pairs in copies.items()}
    print("recall of edited copies", recall, "others", len(found - set().union(*copies.values())))
    assert recall[0.05] == 1.0 and recall[0.1] == 1.0 and recall[0.15] > 0.95
