"""Problem 6: encode every text of a corpus with a public byte-level vocabulary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe

#: Texts taken out of an Arrow batch at once.
TOGETHER = 256


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """``key`` and ``ids`` (array<int>) for each row of ``df``.

    The work is narrow: each Arrow batch is encoded where its rows lie, and nothing is shuffled.  Special tokens aren't
    recognised, their strings are ordinary text.  NULL and empty texts give an empty list; other columns are not read;
    repeated rows stay repeated; an empty table gives no rows.
    """
    path = bpe.shipped(df.sparkSession, ranks)
    source = df.select(df[key].alias("key"), df[text].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                parts = [encoder.ids(t) for t in some.column(1).to_pylist()]
                offsets = np.zeros(len(parts) + 1, np.int32)
                np.cumsum([len(p) for p in parts], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))
                yield pa.RecordBatch.from_arrays([some.column(0), ids], ["key", "ids"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
