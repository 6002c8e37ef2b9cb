"""Operator 1: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices


def token_counts(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 512) -> DataFrame:
    """Per row: ``id_col``, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > ``limit``).

    Counts equal the library's without begin, end or added special tokens;
    strings of special tokens inside a text count as one.  A null or empty text
    counts 0; null ids stay null; repeated rows each give a row; an empty table
    gives none.  Only the two named columns are read, others may have any name.
    One pass over the scan's own splits, no shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def run(it):
        from .bpe import counter

        c = counter(vocab_path)
        for b in slices(it):
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array([c.count(t) for t in texts], pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = src.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens",
                      (F.col("n_tokens") > limit).alias("over_limit"))
