"""Shared pieces of the text operators: scans, row identity, Arrow batches, scratch tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Rows of an Arrow batch that are turned into Python objects at once.
SLICE_ROWS = 256
#: Rows of a batch of texts that Spark sends to Python inside ``short_batches``.
SHORT_ROWS = 1000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain parquet scan: Spark's own splits, no extra shuffle."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Tables (name, path, table of the catalogue or None) of the open ``scratch`` blocks.
_written: list[list[tuple[str, str, str | None]]] = []


@contextmanager
def scratch(spark: SparkSession, *keep: str):
    """Delete the tables that the block has written but for those named in
    ``keep``: what the block returns must be written under such a name.  After
    an error all stay."""
    _written.append([])
    try:
        yield
    except BaseException:
        _written.pop()
        raise
    for name, path, table in _written.pop():
        if name in keep:
            if _written:
                _written[-1].append((name, path, table))
            continue
        discard(spark, path, table)


def discard(spark: SparkSession, path: str, table: str | None = None) -> None:
    """Delete a written table that nothing reads any more."""
    if table:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def superseded(spark: SparkSession, name: str) -> None:
    """Delete the tables of this name in the innermost ``scratch`` block now."""
    for entry in [e for e in _written[-1] if e[0] == name]:
        discard(spark, *entry[1:])
        _written[-1].remove(entry)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the
    lineage with a table that survives lost executors."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if _written:
        _written[-1].append((name, path, None))
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The same as a table that is bucketed by ``keys``: later joins on them
    read it as it lies and shuffle their other side only."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:12]}"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{table}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(table)
    if _written:
        _written[-1].append((name, path, table))
    return spark.table(table)


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two never-null longs that identify a row by id and whole text.

    Rows that repeat both are one key; each is still its own occurrence."""
    return (F.xxhash64(doc_id, text).alias("__k1"),
            F.xxhash64(text, F.lit(7), doc_id).alias("__k2"))


def batches(frame: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
            schema: str) -> DataFrame:
    return frame.mapInArrow(fn, schema)


@contextmanager
def short_batches(spark: SparkSession, rows: int = SHORT_ROWS) -> Iterator[None]:
    """What is written inside goes to Python in batches of ``rows`` at most: a batch of
    texts is held several times over, in the JVM's buffers and in the worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(old)) if int(old) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def slices(it: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into short ones, so that Python objects stay few."""
    for b in it:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
