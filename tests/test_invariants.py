"""Invariants: results do not depend on the shuffle partitioning, and the
TTL de-duplication stream serves a key again only after its state expires."""

import datetime as dt
import os
import tempfile
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from oracle_check import rows_of
from quarry.streaming import monitor as S

QUERIES = E.queries()


@pytest.mark.parametrize("name", ["h01_kfold", "h06_time_series_split", "d03_batch_search", "e05_bfs_hops",
                                  "j01_distance_ad", "f10_correlation_spearman", "i05_mutual_info"])
def test_partition_independent(name, spark, sf):
    out = []
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = QUERIES[name](spark, sf)
            out.append(rows_of(df.columns, [tuple(r) for r in df.collect()], 9))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert out[0] == out[1]


def test_ttl_dedupe_across_batches(spark):
    d = tempfile.mkdtemp(prefix="quarry-ttl-")
    t0 = dt.datetime(2024, 1, 1, 0, 0, 0)
    batches = [[(1, "a", t0)],
               [(1, "a", t0 + dt.timedelta(minutes=10))],           # within ttl: dropped
               [(2, "b", t0 + dt.timedelta(hours=3))],              # advances the watermark
               [(3, "c", t0 + dt.timedelta(hours=3))],              # state past the watermark is evicted here
               [(1, "a", t0 + dt.timedelta(hours=3, minutes=1))]]   # expired: served again
    for i, rows in enumerate(batches):
        tbl = pa.table({"user_id": [r[0] for r in rows], "event_type": [r[1] for r in rows],
                        "ts": pa.array([r[2] for r in rows], pa.timestamp("us"))})
        pq.write_table(tbl, os.path.join(d, f"part-{i:03d}.parquet"))
        time.sleep(1.1)  # file streams pick files in modification-time order
    schema = spark.read.parquet(d).schema
    out = S.run_available(S.dedupe_within(S.read_stream(spark, d, schema, max_files=1), "ts",
                                          ["user_id", "event_type"], "1 hour"), "ttl-test")
    got = sorted((r["user_id"], r["event_type"]) for r in spark.read.parquet(out).collect())
    assert got == [(1, "a"), (1, "a"), (2, "b"), (3, "c")]
