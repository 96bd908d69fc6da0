"""Byte-pair encoding by per-prefix dynamic programming.

For every prefix of a pre-token exactly one token can be the last one of the prefix's encoding: the one whose left
neighbour (the last token of the shorter prefix) stays separate from it when both are merged together.  An automaton
over the vocabulary yields, for each prefix, the longest token that is a suffix of it; shorter candidates follow by
suffix links.  Storing one last token per prefix and following the back-pointers gives the exact ids in time linear
in the text, with no merge loop over the whole word.
"""

from __future__ import annotations

import base64
import os
import pathlib
import re
from collections import deque
from itertools import chain

import numpy as np
import regex
from pyspark import SparkFiles
from pyspark.sql import SparkSession

#: Fixed value: the pattern by which this public vocabulary splits text before merging.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same language over ASCII alone, for the standard library's faster matcher.
_BLANK = r" \t\n\r\f\v"
_ASCII = rf""" ?[A-Za-z]++| ?[0-9]++|'(?:s|t|re|ve|m|ll|d)| ?[^{_BLANK}A-Za-z0-9]++|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]"""
_any_words, _ascii_words = regex.compile(SPLIT_PATTERN).findall, re.compile(_ASCII).findall

#: Between a visible ASCII character and a line feed no pre-token goes on, so both sides split independently.
_line_ends = re.compile(r"(?<=[!-~])(?=\n)")

#: Pre-tokens longer than this aren't kept in the memo; entries beyond MEMO_ENTRIES start it anew.
MEMO_CHARS, MEMO_ENTRIES = 64, 1_000_000


def default_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The rank file's place; ``TESSELLA_TOKENIZERS`` names another folder than /opt/tokenizers."""
    return os.path.join(os.environ.get("TESSELLA_TOKENIZERS", "/opt/tokenizers"), name)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a rank file (base64 token, space, rank on each line)."""
    lines = pathlib.Path(path).read_bytes().splitlines()
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)}


class Vocabulary:
    """Ranks, the suffix automaton over the tokens, and the memoised pair test."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.length = {i: len(t) for i, t in self.tokens.items()}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._single: dict[int, bool] = {}
        self._build()

    def _build(self) -> None:
        goto: dict[int, int] = {}
        text, own = [b""], [-1]
        for token, i in self.ranks.items():
            state = 0
            for byte in token:
                key = state << 8 | byte
                nxt = goto.get(key)
                if nxt is None:
                    nxt = goto[key] = len(own)
                    own.append(-1)
                state = nxt
            own[state] = i
        n = len(own)
        children: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for key, nxt in goto.items():
            children[key >> 8].append((key & 255, nxt))
        link, longest = [0] * n, own[:]
        shorter: dict[int, int] = {}
        queue = deque(nxt for _, nxt in children[0])
        while queue:
            state = queue.popleft()
            below = longest[link[state]]
            if own[state] < 0:
                longest[state] = below
            elif below >= 0:
                shorter[own[state]] = below
            for byte, nxt in children[state]:
                back = link[state]
                while back and (back << 8 | byte) not in goto:
                    back = link[back]
                to = goto.get(back << 8 | byte, 0)
                link[nxt] = to if to != nxt else 0
                queue.append(nxt)
        self.goto, self.link, self.longest, self.shorter = goto, link, longest, shorter

    def merge(self, data: bytes) -> list[int]:
        """Encoding by definition: merge the adjacent pair of lowest rank until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], 1 << 60))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether the token is the encoding of its own bytes."""
        known = self._single.get(token)
        if known is None:
            known = self._single[token] = self.merge(self.tokens[token]) == [token]
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their joined bytes are encoded."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) > MEMO_ENTRIES:
                self._pairs.clear()
            known = self._pairs[left, right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None and self.stands(whole):
            return [whole]
        goto, link, longest, shorter, length = self.goto, self.link, self.longest, self.shorter, self.length
        last: list[int] = []
        state = 0
        for end, byte in enumerate(data, 1):
            key = state << 8 | byte
            while key not in goto and state:
                state = link[state]
                key = state << 8 | byte
            state = goto.get(key, 0)
            token = longest[state]
            while True:
                start = end - length[token]
                if self.compatible(last[start - 1], token) if start else self.stands(token):
                    break
                token = shorter[token]
            last.append(token)
        out, end = [], len(data)
        while end:
            out.append(last[end - 1])
            end -= length[last[end - 1]]
        out.reverse()
        return out


def pre_tokens(text: str) -> list[str]:
    """The text's pre-tokens, as SPLIT_PATTERN finds them."""
    if text.isascii():
        return _ascii_words(text)
    out: list[str] = []
    for part in _line_ends.split(text):
        out += _ascii_words(part) if part.isascii() else _any_words(part)
    return out


class _Memo(dict):
    """Pre-token to a tuple made by ``make``; bounded, so a worker's memory doesn't grow with the corpus."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word: str):
        value = self.make(word)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO_ENTRIES:
                self.clear()
            self[word] = value
        return value


class Encoder:
    """Text to ids, or to the characters of each token, with memoised pre-tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.vocabulary = Vocabulary(ranks)
        self._ids = _Memo(lambda w: tuple(self.vocabulary.encode_bytes(w.encode("utf-8", "replace"))))
        self._spans = _Memo(self._span)

    def _span(self, word: str) -> tuple[int, ...]:
        """Characters that begin in each token; ``-1 - n`` marks a token that begins inside a character."""
        out = []
        for i in self._ids[word]:
            token = self.vocabulary.tokens[i]
            n = sum(byte & 0xC0 != 0x80 for byte in token)
            out.append(-1 - n if token[0] & 0xC0 == 0x80 else n)
        return tuple(out)

    def ids(self, text: str | None) -> np.ndarray:
        """int32 ids of the text; none for an empty or missing one."""
        if not text:
            return np.empty(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self._ids.__getitem__, pre_tokens(text))), np.int32)

    def spans(self, text: str) -> np.ndarray:
        """int16 character counts of the tokens, marked as in ``_span``."""
        return np.fromiter(chain.from_iterable(map(self._spans.__getitem__, pre_tokens(text))), np.int16)


def shipped(spark: SparkSession, path: str | None = None) -> str:
    """The name under which workers find the rank file, which the driver sends to every executor."""
    path = path or default_path()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """The encoder for a rank file (a path, or what ``shipped`` returned): built once in each Python worker."""
    path = path or default_path()
    if not os.path.isfile(path):
        path = SparkFiles.get(os.path.basename(path))
    if path not in _encoders:
        _encoders[path] = Encoder(read_ranks(path))
    return _encoders[path]
