"""Problem 8: cut oversized texts into overlapping pieces at natural boundaries.

Large texts are read in ranges that end where no pre-token can go on.  For a file, workers look for such a place in a
halo after each range's first byte, these places are stitched to a table of ranges, and each range is then read by its
offsets; a text that is a row's value is cut at such places in one go.  Ranges are dealt to all tasks, which count
tokens and list the natural boundaries (section, paragraph, line and sentence ends).  The boundary tables of one text
are then stitched in order: prefix sums of the lengths give every boundary its offset in the whole text, and pieces come
out as offsets, and as stretches of ranges, while at most one piece's tokens are held.  Texts of a single range need
no stitching and no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.plans.materialize import cut, task_count

from . import bpe

SECTION, PARAGRAPH, LINE, SENTENCE, TOKEN = 1, 2, 3, 4, 5
LEVELS = {SECTION: "section", PARAGRAPH: "paragraph", LINE: "line", SENTENCE: "sentence", TOKEN: "token"}

_section = re.compile(
    r"\n(?=[ \t]*(?:\\(?:(?:sub)*section|chapter|part|paragraph|appendix|bibliography|begin\{(?:abstract|document|"
    r"thebibliography)\})|\#{1,6} ))"
)
_STOPS = np.array([ord(c) for c in ".!?。！？"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]”’"], np.uint32)
_BLANKS = np.array([ord(c) for c in " \t\r\n\f\v\u00a0\u2028\u2029\u3000"], np.uint32)

#: No pre-token crosses a change from a visible character to white space, or between ASCII letters and digits.
_seam = re.compile(r"(?<=\S)(?=[ \t\n\r])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")

_OFFSETS = "piece_no int, first_token long, end_token long, first_char long, end_char long, cut_at string, n_tokens long"


def natural_places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Character offsets at which the text may be cut, and their levels; a break counts before and after its line end."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    after = np.append(a[1:], 0)[: len(a)]
    blank = np.isin(a, _BLANKS)
    ends = np.flatnonzero((a == 10) | ((a == 13) & (after != 10)))  # a line feed, or a lone carriage return
    starts = ends - ((a[ends] == 10) & (ends > 0) & (a[ends - 1] == 13))
    visible = np.append(0, np.cumsum(~blank))
    between = np.diff(visible[ends]) if len(ends) else np.empty(0, np.int64)
    empty = between == 0  # nothing but white space between a line end and the next
    in_break = np.append(empty, False) | np.append(False, empty) if len(ends) else np.empty(0, bool)
    line_level = np.where(in_break, PARAGRAPH, LINE).astype(np.int8)
    stop = np.isin(a, _STOPS)
    closer = np.isin(a, _CLOSERS)
    before_blank, last = np.append(blank[1:], False)[: len(a)], []
    for _ in range(3):  # the stop itself, or one or two closing quotes or brackets after it
        last.append(np.flatnonzero(stop & before_blank))
        stop = np.append(False, stop[:-1])[: len(a)] & closer
    sentence = np.concatenate(last) + 1
    section = np.array([m.start() for m in _section.finditer(text)], np.int64)
    at = np.concatenate([section, section + 1, ends + 1, starts, sentence])
    level = np.concatenate([np.full(2 * len(section), SECTION), line_level, line_level, np.full(len(sentence), SENTENCE)]).astype(np.int8)
    inside = (at > 0) & (at < len(a))
    return at[inside], level[inside]


def boundaries(text: str, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token offsets of the natural boundaries of ``text``, and their levels; only those where a token ends."""
    ends = np.cumsum(np.where(spans < 0, -1 - spans, spans), dtype=np.int64)
    at, level = natural_places(text)
    if not len(at):
        return at.astype(np.int64), level
    token = np.searchsorted(ends, at)
    good = (token < len(ends)) & (ends[np.minimum(token, len(ends) - 1)] == at)
    # tokens that add no character share an end: the boundary stands after the last of them
    token, level = np.searchsorted(ends, at[good], side="right"), level[good]
    order = np.lexsort((level, token))
    token, level = token[order], level[order]
    first = np.ones(len(token), bool)
    first[1:] = token[1:] != token[:-1]
    return token[first], level[first]


class Cutter:
    """Pieces of one text, fed range by range; holds the tokens of one piece and of the range at hand."""

    def __init__(self, limit: int, overlap: int):
        self.limit, self.overlap = limit, overlap
        self.spans = np.empty(0, np.int16)
        self.token, self.level = np.empty(0, np.int64), np.empty(0, np.int8)
        self.first = self.first_char = self.piece = 0

    def feed(self, spans: np.ndarray, token: np.ndarray, level: np.ndarray, last: bool) -> Iterator[tuple]:
        self.token = np.concatenate([self.token, token + len(self.spans)])
        self.level = np.concatenate([self.level, level])
        self.spans = np.concatenate([self.spans, spans])
        glued = self.spans < 0
        ends = np.concatenate([[0], np.cumsum(np.where(glued, -1 - self.spans, self.spans), dtype=np.int64)])
        n, at = len(self.spans), 0
        while n - at > self.limit:  # another token follows the largest piece, so a cut is due
            end, kind = self._cut(at, glued)
            yield self._row(at, end, ends, LEVELS[kind])
            back = end - self.overlap
            while back > at and glued[back]:
                back -= 1
            at = back if back > at else end
        if last:
            yield self._row(at, n, ends, "end")
        keep = np.searchsorted(self.token, at, side="right")
        self.first += at
        self.first_char += int(ends[at])
        self.spans, self.token, self.level = self.spans[at:], self.token[keep:] - at, self.level[keep:]

    def _cut(self, at: int, glued: np.ndarray) -> tuple[int, int]:
        hi = np.searchsorted(self.token, at + self.limit, side="right")
        for floor in (at + self.limit // 2, at + self.overlap):  # a piece at least half full, if it can be
            lo = np.searchsorted(self.token, floor, side="right")
            if lo < hi:
                level = self.level[lo:hi]
                best = level.min()
                return int(self.token[lo + np.flatnonzero(level == best)[-1]]), int(best)
        end = at + self.limit
        while end > at + self.overlap + 1 and glued[end]:  # never within a character
            end -= 1
        return end, TOKEN

    def _row(self, at: int, end: int, ends: np.ndarray, kind: str) -> tuple:
        self.piece += 1
        return (
            self.piece - 1, self.first + at, self.first + end,
            self.first_char + int(ends[at]), self.first_char + int(ends[end]), kind,
        )


_RANGE = "doc_id {k}, row string, range_no int, ranges int, body string"
_TABLE = _RANGE + ", n_tokens long, spans binary, tokens binary, levels binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _whole(limit: int, overlap: int, path: str, with_text: bool):
    """Function for mapInPandas: the pieces of texts of one range; with their characters, of oversized texts only."""
    columns = ["doc_id", *_names(_OFFSETS), *(["piece_text"] if with_text else [])]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.encoder(path)
        for frame in frames:
            rows = []
            for doc, text in frame.itertuples(index=False, name=None):
                text = text or ""
                spans = encoder.spans(text) if text else np.empty(0, np.int16)
                over = len(spans) > limit
                if with_text and not over:
                    continue
                table = boundaries(text, spans) if over else (np.empty(0, np.int64), np.empty(0, np.int8))
                for row in Cutter(limit, overlap).feed(spans, *table, True):
                    rows.append((doc, *row, len(spans), text[row[3] : row[4]]) if with_text else (doc, *row, len(spans)))
            yield pd.DataFrame(rows, columns=columns)

    return run


def _places(text: str, size: int) -> list[int]:
    """Where the text's ranges begin and end: each is the first seam after ``size`` characters of the former range."""
    out = [0]
    while (m := _seam.search(text, out[-1] + size)) is not None:
        out.append(m.end())
    return [*out, len(text)]


def _ranges(size: int):
    """Function for mapInPandas: one row for each range of each text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for doc, row, text in frame.itertuples(index=False, name=None):
                places = _places(text, size)
                for k in range(0, len(places) - 1, 64):
                    part = [(doc, row, no, len(places) - 1, text[places[no] : places[no + 1]]) for no in range(k, min(k + 64, len(places) - 1))]
                    yield pd.DataFrame(part, columns=_names(_RANGE))

    return run


def _tables(path: str):
    """Function for mapInPandas: each range with its tokens and natural boundaries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = bpe.encoder(path)
        for frame in frames:
            rows = []
            for body in frame["body"]:
                spans = encoder.spans(body) if body else np.empty(0, np.int16)
                token, level = boundaries(body, spans)
                rows.append((len(spans), spans.tobytes(), token.astype(np.int32).tobytes(), level.tobytes()))
            got = pd.DataFrame(rows, columns=["n_tokens", "spans", "tokens", "levels"])
            yield pd.concat([frame.reset_index(drop=True), got], axis=1)

    return run


def _stitch(limit: int, overlap: int):
    """Function for mapInPandas over boundary tables in order: pieces with the stretches of ranges they are made of."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter, starts = None, [0]
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                if r.at == 1:
                    cutter, starts = Cutter(limit, overlap), [0]
                spans = np.frombuffer(r.spans, np.int16)
                starts.append(starts[-1] + int(np.where(spans < 0, -1 - spans, spans).sum(dtype=np.int64)))
                token = np.frombuffer(r.tokens, np.int32).astype(np.int64)
                for row in cutter.feed(spans, token, np.frombuffer(r.levels, np.int8), r.at == r.ranges):
                    first, end, parts = row[3], row[4], []
                    for no in range(bisect_right(starts, first) - 1, r.range_no + 1):
                        lo, hi = max(first, starts[no]), min(end, starts[no + 1])
                        if lo < hi:
                            parts.append({"range_no": no, "start": lo - starts[no], "n": hi - lo})
                    rows.append((r.doc_id, *row, r.total, r.row, parts))
            yield pd.DataFrame(rows, columns=["doc_id", *_names(_OFFSETS), "row", "parts"])

    return run


def _assembled(tables: DataFrame, kind: str, limit: int, overlap: int, with_text: bool) -> DataFrame:
    """The pieces of the texts whose ranges ``tables`` has; with their characters, of oversized texts only."""
    totals = tables.groupBy("row").agg(F.sum("n_tokens").alias("total"))
    if with_text:
        totals = totals.where(F.col("total") > limit)
    # the window, which the function's place in the text comes from, holds each text's ranges together in order, also
    # where joins are planned anew at run time
    at = F.row_number().over(Window.partitionBy("row").orderBy("range_no"))
    in_order = tables.select("doc_id", "row", "range_no", "ranges", "spans", "tokens", "levels").join(totals, "row").withColumn("at", at)
    schema = f"doc_id {kind}, {_OFFSETS}, row string, parts array<struct<range_no: int, start: int, n: int>>"
    pieces = in_order.mapInPandas(_stitch(limit, overlap), schema)
    columns = ["doc_id", *_names(_OFFSETS)]
    if not with_text:
        return pieces.select(columns)
    stretch = pieces.select("*", F.inline("parts")).drop("parts").join(tables.select("row", "range_no", "body"), ["row", "range_no"])
    text = F.struct("range_no", F.expr("substring(body, start + 1, n)").alias("text"))
    joined = stretch.groupBy("row", *columns).agg(F.array_sort(F.collect_list(text)).alias("texts"))
    return joined.select(*columns, F.array_join("texts.text", "").alias("piece_text"))


def _pieces(df: DataFrame, key: str, text: str, limit: int, overlap: int, range_chars: int, ranks: str | None, with_text: bool) -> DataFrame:
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be less than half the limit")
    spark, path = df.sparkSession, bpe.shipped(df.sparkSession, ranks)
    source = df.select(df[key].alias("doc_id"), df[text].cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {_OFFSETS}" + (", piece_text string" if with_text else "")
    whole = source.where(F.coalesce(F.length("text"), F.lit(0)) <= range_chars).mapInPandas(_whole(limit, overlap, path, with_text), schema)
    large = source.where(F.length("text") > range_chars)
    name = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("\x01")), F.lit("\x02"), "text"))
    ranges = (
        large.select("doc_id", name.alias("row"), "text").mapInPandas(_ranges(range_chars), _RANGE.format(k=kind))
        .repartition(task_count(spark), "row", "range_no").dropDuplicates(["row", "range_no"])
    )
    tables = cut(ranges.select(_names(_RANGE)).mapInPandas(_tables(path), _TABLE.format(k=kind)), "ranges")
    return whole.unionByName(_assembled(tables, kind, limit, overlap, with_text)).withColumnRenamed("doc_id", key)


def piece_offsets(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 1024,
    overlap: int = 64,
    range_chars: int = 65_536,
    ranks: str | None = None,
) -> DataFrame:
    """Offsets of the pieces of every text: one row for a text within the limit, several for an oversized one.

    Columns: the key, ``piece_no`` from 0, token and character offsets (end excluded), ``cut_at`` (what kind of
    boundary ends the piece; ``end`` for the last) and ``n_tokens`` of the whole text.  Consecutive pieces share
    ``overlap`` tokens, a few more where the overlap would begin within a character.  NULL and empty texts give one
    empty piece.  Different texts of one key, NULL included, are cut apart from one another; whole repeats of a text of
    more than ``range_chars`` characters give its pieces once.  Other columns aren't read; an empty table gives no rows.
    """
    return _pieces(df, key, text, limit, overlap, range_chars, ranks, False)


def split_texts(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 1024,
    overlap: int = 64,
    range_chars: int = 65_536,
    ranks: str | None = None,
) -> DataFrame:
    """The pieces of oversized texts with their characters (``piece_text``), otherwise as ``piece_offsets``.

    The text is rebuilt by dropping from each piece the characters before the former piece's ``end_char``.  Only texts
    of more than ``range_chars`` characters are shuffled, as ranges.
    """
    return _pieces(df, key, text, limit, overlap, range_chars, ranks, True)


def _read_bytes(path: str, at: int, n: int) -> bytes:
    """``n`` bytes of a file from ``at`` on, from a local path or whatever store the path names."""
    if path.startswith("file:"):
        with open("/" + unquote(path[5:]).lstrip("/"), "rb") as f:
            f.seek(at)
            return f.read(n)
    store, place = pa.fs.FileSystem.from_uri(path)
    with store.open_input_file(place) as f:
        f.seek(at)
        return f.read(n)


def _file_seams(size: int, halo: int):
    """Function for mapInPandas: for each range of a file the byte at which the first pre-token in its halo begins; -1 if none is seen there."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            at = []
            for path, no in zip(frame["path"], frame["range_no"]):
                if no == 0:
                    at.append(0)
                    continue
                data = _read_bytes(path, no * size - 1, halo + 1)  # with a byte before, for the seam's look back
                lead = next((k for k, byte in enumerate(data[:4]) if byte & 0xC0 != 0x80), 0)
                text = data[lead:].decode("utf-8", "surrogateescape")
                m = _seam.search(text, 1)
                at.append(no * size - 1 + lead + len(text[: m.end()].encode("utf-8", "surrogateescape")) if m else -1)
            yield pd.DataFrame({"path": frame["path"].to_numpy(), "length": frame["length"].to_numpy(), "at": at})

    return run


def _file_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        body = [_read_bytes(p, a, n).decode("utf-8", "replace") for p, a, n in zip(frame["path"], frame["at"], frame["n"])]
        yield pd.DataFrame({"doc_id": frame["path"], "row": frame["path"], "range_no": frame["range_no"], "ranges": frame["ranges"], "body": body})


def split_files(
    spark: SparkSession, paths: str | list[str], limit: int = 1024, overlap: int = 64, range_bytes: int = 1 << 20, halo: int = 4_096, ranks: str | None = None
) -> DataFrame:
    """The pieces of oversized text files, as ``split_texts`` with ``path`` for a key; no task reads a whole file.

    Where a halo shows no place to part pre-tokens, a range goes on to the next one that does.  Bytes that aren't
    UTF-8 become U+FFFD; an empty file gives no piece.
    """
    tasks = task_count(spark)
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")
    starts = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / range_bytes).cast("int"))).alias("range_no"))
    seams = starts.repartition(tasks, "path", "range_no").mapInPandas(_file_seams(range_bytes, halo), "path string, length long, at long").where("at >= 0 and at < length")
    of_file = Window.partitionBy("path").orderBy("at")
    table = (
        seams.distinct().withColumn("n", F.lead("at").over(of_file)).withColumn("n", F.coalesce("n", "length") - F.col("at"))
        .withColumn("range_no", F.row_number().over(of_file) - 1).withColumn("ranges", F.count(F.lit(1)).over(Window.partitionBy("path")).cast("int"))
    )
    bodies = table.repartition(tasks, "path", "at").mapInPandas(_file_ranges, _RANGE.format(k="string"))
    tables = cut(bodies.mapInPandas(_tables(bpe.shipped(spark, ranks)), _TABLE.format(k="string")), "ranges")
    return _assembled(tables, "string", limit, overlap, True).withColumnRenamed("doc_id", "path")
