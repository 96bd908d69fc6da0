from __future__ import annotations

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import bpe
from tessella.llm.encoding import encode_corpus

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.default_path()), reason="no vocabulary here")
TEXTS = [
    "", " ", "\n\n\n", "Hello  world's 123abc", "naïve café — “quoted”", "<|endoftext|> is text", "日本語のテキスト", "🙂👩‍👩‍👧", "a" * 5000, " " * 700, "\t\r\n mixed\x0b\x1c\x85  x",
    "'sll've'tm d'S", "²³ 5²x Ⅷ", "é ä", "�￾", "x" * 63 + "y" * 70, "\n \n  \nword", "١٢٣ ٤", "_under_score_",
]


@pytest.fixture(scope="module")
def public():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_equals_public_tokenizer(public, text):
    assert bpe.encoder().ids(text).tolist() == public(text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_random_texts(text):
    e = bpe.encoder()
    ids = e.ids(text)
    assert b"".join(e.vocabulary.tokens[i] for i in ids) == text.encode("utf-8", "replace")
    spans = e.spans(text)
    assert len(spans) == len(ids) and int(np.where(spans < 0, -1 - spans, spans).sum()) == len(text)


@given(st.text(alphabet="abcdest nrail'", max_size=40))
@settings(max_examples=300, deadline=None)
def test_dynamic_programme_equals_merging(text):
    v = bpe.encoder().vocabulary
    for word in bpe.pre_tokens(text):
        assert v.encode_bytes(word.encode()) == v.merge(word.encode())


def test_small_memo_changes_nothing(monkeypatch, public):
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 3)
    e = bpe.Encoder(bpe.read_ranks(bpe.default_path()))
    for text in TEXTS:
        assert e.ids(text).tolist() == public(text)


def test_frame(spark, public):
    rows = [(1, "a b", "x", [9]), (1, "a b", "x", [9]), (2, None, None, None), (3, "", "", None), (None, "tie", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string, ids array<int>")
    got = sorted(((r.doc_id, r.ids) for r in encode_corpus(df).collect()), key=repr)
    assert got == sorted([(1, public("a b"))] * 2 + [(2, []), (3, []), (None, public("tie"))], key=repr)
    assert encode_corpus(df.limit(0)).columns == ["doc_id", "ids"] and encode_corpus(df.limit(0)).count() == 0
