from __future__ import annotations

import os
import random

import pytest

from tessella.llm import bpe
from tessella.llm.splitting import piece_offsets, split_files, split_texts

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.default_path()), reason="no vocabulary here")


def article(seed, words=1500):
    r = random.Random(seed)
    out = []
    for i in range(words):
        out.append(r.choice(["alpha", "beta", "γάμμα", "42", "naïve", "x_1", "日本"]) + r.choice([" ", " ", " ", ". ", ".\n", "\n\n", "\r\n", "\n\\section{S} "]))
    return "".join(out)


TEXTS = {1: article(1), 2: "short", 3: None, 4: "", 5: "日" * 3000, 6: "ab" * 4000, 7: " " * 4000, 8: article(8, 400), 9: "🙂" * 1200, 10: "word " * 4000, 11: "a1" * 3000}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").selectExpr("*", "'clash' as piece_no", "1 as row")


@pytest.mark.parametrize("size", [65_536, 700, 300])
def test_pieces_cover_and_overlap(docs, size):
    limit, overlap, e = 128, 16, bpe.encoder()
    by_doc = {}
    for r in split_texts(docs, limit=limit, overlap=overlap, range_chars=size).collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == {k for k, t in TEXTS.items() if t and len(e.ids(t)) > limit}
    for doc, pieces in by_doc.items():
        text, n = TEXTS[doc], len(e.ids(TEXTS[doc]))
        pieces.sort(key=lambda r: r.piece_no)
        assert [p.piece_no for p in pieces] == list(range(len(pieces)))
        assert pieces[0].first_token == 0 and pieces[-1].end_token == n and all(p.n_tokens == n for p in pieces)
        rebuilt, end = "", 0
        for p in pieces:
            assert p.piece_text == text[p.first_char : p.end_char] and 0 < p.end_token - p.first_token <= limit
            rebuilt, end = rebuilt + p.piece_text[end - p.first_char :], p.end_char
        assert rebuilt == text
        for a, b in zip(pieces, pieces[1:]):
            assert overlap <= a.end_token - b.first_token <= overlap + 3


def test_ranges_do_not_change_pieces(docs):
    def pieces(size):
        return sorted(map(tuple, piece_offsets(docs, limit=128, overlap=16, range_chars=size).collect()))

    assert pieces(300) == pieces(65_536)


def test_natural_boundaries_are_used(spark):
    text = ("word " * 60 + ".\n\n") * 6
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    kinds = [r.cut_at for r in piece_offsets(df, limit=100, overlap=8).orderBy("piece_no").collect()]
    assert set(kinds[:-1]) == {"paragraph"} and kinds[-1] == "end"


def test_small_and_missing_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.piece_no, r.end_token, r.n_tokens) for r in piece_offsets(df).collect()), key=repr)
    assert rows == sorted([(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 1, 1), (3, 0, 1, 1), (None, 0, 1, 1)], key=repr)
    assert piece_offsets(df.limit(0)).count() == 0


def test_equal_keys_with_different_long_texts(spark):
    a, b = article(3, 600), article(4, 700)
    df = spark.createDataFrame([(1, a), (1, b), (None, a)], "doc_id long, text string")
    rows = piece_offsets(df, limit=128, overlap=16, range_chars=500).collect()
    ends = sorted(((r.doc_id, r.end_char) for r in rows if r.cut_at == "end"), key=repr)
    assert ends == sorted([(1, len(a)), (1, len(b)), (None, len(a))], key=repr)
    with pytest.raises(ValueError):
        piece_offsets(df, limit=10, overlap=5)


def test_files_are_cut_like_values(spark, tmp_path):
    texts = {"a b.txt": article(5, 4000), "seamless": "日本" * 3000 + " end " + "x" * 9000 + "\n" + "word " * 500, "small": "short", "empty": ""}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    wanted = sorted(tuple(r)[1:] for r in split_texts(df, "name", limit=128, overlap=16).collect())
    for size, halo in ((1 << 20, 4096), (1000, 100), (333, 20)):
        got = split_files(spark, str(tmp_path), limit=128, overlap=16, range_bytes=size, halo=halo)
        assert sorted(tuple(r)[1:] for r in got.collect()) == wanted
    assert len(wanted) > 100


def test_ranges_of_one_text_are_dealt_out(spark, monkeypatch):
    import time

    from pyspark.sql import functions as F

    from tessella.llm import splitting

    seen = []
    keep = splitting.cut
    monkeypatch.setattr(splitting, "cut", lambda df, name="cut": seen.append(keep(df, name)) or seen[-1])
    text, took = article(1, 20_000), []
    for times in (4, 16):
        df = spark.createDataFrame([(1, text * times)], "doc_id long, text string")
        began = time.time()
        n = split_texts(df).where("cut_at = 'end'").first()
        took.append(time.time() - began)
        assert n.end_char == len(text) * times
    files = seen[-1].select(F.input_file_name().alias("f")).groupBy("f").count().collect()
    assert len(files) > 4 and max(r["count"] for r in files) < 0.3 * sum(r["count"] for r in files)
    assert took[1] < 8 * took[0] + 5


def test_places_are_found_once():
    from tessella.llm.splitting import _places

    assert _places("a" * 100, 10) == [0, 100] and _places("ab cd ef", 3) == [0, 5, 8]
    text = "x" * 3_000_000 + " " + "y z " * 50_000
    places = _places(text, 1000)
    assert places[:2] == [0, 3_000_000] and places == sorted(set(places)) and len(places) > 150


def test_natural_places():
    from tessella.llm.splitting import LINE, PARAGRAPH, SECTION, SENTENCE, natural_places

    text = 'One. "Two."\nthree\r\n \nfour\n\\section{x} e.g.x\r5?'
    got = {}
    for at, level in zip(*natural_places(text)):
        got[int(at)] = min(int(level), got.get(int(at), 9))
    assert got[text.index("One.") + 4] == SENTENCE and got[text.index("\nthree")] == LINE and got[text.index("three")] == LINE
    assert got[text.index("\r\n ")] == PARAGRAPH and got[text.index("four")] == PARAGRAPH
    assert got[text.index("\\section")] == SECTION and got[text.index("\r5")] == LINE and text.index(".x") + 1 not in got
    assert [len(x) for x in natural_places("")] == [0, 0] and [len(x) for x in natural_places("abc")] == [0, 0]


@pytest.mark.parametrize("threshold", ["256k", "-1"])
def test_ranges_stay_in_order_when_joins_are_planned_anew(spark, threshold):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.createDataFrame([(k, article(k, 700)) for k in range(40)], "doc_id long, text string").repartition(8)
        pieces = {}
        for r in split_texts(df, limit=128, overlap=16, range_chars=300).collect():
            pieces.setdefault(r.doc_id, {})[r.piece_no] = r
        for doc, found in pieces.items():
            assert found[max(found)].end_char == len(article(doc, 700)) and sorted(found) == list(range(len(found)))
        assert len(pieces) == 40
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
