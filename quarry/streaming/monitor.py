"""Structured Streaming versions of the monitoring surfaces.

Every stream reads files with ``readStream``, keeps its state bounded by a
watermark, checkpoints into the shared folder named by
``spark.checkpoint.dir`` (so a restarted driver resumes and lost executors
only replay their tasks), and writes through ``foreachBatch``:

* aggregates run in ``update`` mode; each micro-batch appends its changed
  rows tagged with the batch id, and the current table is the latest row
  per key (``latest``) — exact even for windows still open when the input
  ends, which append mode would hold back;
* row streams (validate / predict / de-duplicate) append.

``run_available`` drives a query with the ``availableNow`` trigger (all
input present now, in as many micro-batches as the source limits allow)
and returns the sink as a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def read_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None,
                file_glob: str | None = None) -> DataFrame:
    """File stream over a folder (optionally only files matching ``file_glob``)."""
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    if file_glob:
        r = r.option("pathGlobFilter", file_glob)
    return r.parquet(path)


def event_time(df: DataFrame, ts: str) -> DataFrame:
    """Watermarks need TIMESTAMP (LTZ) event time; NTZ input is read as
    session-zone wall time."""
    if isinstance(df.schema[ts].dataType, T.TimestampNTZType):
        return df.withColumn(ts, F.col(ts).cast("timestamp"))
    return df


def run_available(sdf: DataFrame, name: str, mode: str = "append",
                  sink: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run to completion on the data present now; returns the sink path.
    Default sink: append each micro-batch (with ``batch_id``) to parquet."""
    spark = sdf.sparkSession
    out = scratch_path(spark, name)
    ckpt = scratch_path(spark, name + "-ckpt")

    def default_sink(batch: DataFrame, batch_id: int) -> None:
        # one folder per batch, overwritten on replay: idempotent after a restart
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    q = (sdf.writeStream.outputMode(mode).option("checkpointLocation", ckpt)
         .foreachBatch(sink or default_sink).trigger(availableNow=True).start())
    q.awaitTermination()
    return out


def latest(spark: SparkSession, path: str, keys: Sequence[str], schema: str | None = None) -> DataFrame:
    """Current state of an update-mode sink: the row of the highest batch per key."""
    try:
        df = spark.read.parquet(path)
    except Exception:  # noqa: BLE001  (no batch produced rows)
        if schema is None:
            raise
        return spark.createDataFrame([], schema)
    cols = [c for c in df.columns if c not in keys and c != "batch_id"]
    g = df.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("batch_id")).alias("s"))
    return g.select(*keys, "s.*")


# ---------------------------------------------------------------- S01
def windowed_stats(stream: DataFrame, ts: str, key: str, value: str, window: str = "1 day",
                   watermark: str = "1 day") -> DataFrame:
    """Tumbling-window count / mean / sample std per key (state bounded by
    the watermark; std from running sums inside the aggregate)."""
    return (event_time(stream, ts).withWatermark(ts, watermark)
            .groupBy(F.window(ts, window).alias("w"), key)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("cm"), F.stddev_samp(value).alias("cs"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, "n", "cm", "cs"))


def drift_against(stats: DataFrame, baseline: DataFrame, key: str, threshold: float = 0.05) -> DataFrame:
    """S01 = M12 per window: score = |Δmean|/(std_b + 1e-9) +
    |1 − std_w/(std_b + 1e-9)|, drifted when score > 10·threshold.  The
    baseline is a static per-key table (stream–static join)."""
    score = (F.abs(F.col("cm") - F.col("mean")) / (F.col("std") + 1e-9)
             + F.abs(1 - F.col("cs") / (F.col("std") + 1e-9)))
    return stats.join(baseline, key).select(
        "window_start", "window_end", key, "n", F.col("cm").alias("window_mean"), F.col("cs").alias("window_std"),
        score.alias("drift_score"), (score > threshold * 10).alias("is_drifted"))


def baseline_stats(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


# ---------------------------------------------------------------- S02
def validate_stream(stream: DataFrame, rules: Sequence[tuple[str, F.Column]]) -> DataFrame:
    """B08/B10 on a stream: ``violations`` = names of the failed rules."""
    fails = F.array(*[F.when(~F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules])
    return stream.withColumn("violations", F.filter(fails, lambda x: x.isNotNull()))


def quarantine_sink(good_path: str, bad_path: str) -> Callable[[DataFrame, int], None]:
    """Two sinks from one micro-batch: accepted rows and rejected rows with reasons."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        batch.where(F.size("violations") == 0).drop("violations") \
            .write.mode("overwrite").parquet(f"{good_path}/batch_id={batch_id}")
        batch.where(F.size("violations") > 0).withColumn("reason", F.array_join("violations", ",")).drop("violations") \
            .write.mode("overwrite").parquet(f"{bad_path}/batch_id={batch_id}")
        batch.unpersist()
    return sink


# ---------------------------------------------------------------- S03
def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """Running count, sum and mean per key (update mode)."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"),
                                   F.avg(value).alias("mean"))


# ---------------------------------------------------------------- S04
def dedupe_within(stream: DataFrame, ts: str, keys: Sequence[str], ttl: str = "1 hour") -> DataFrame:
    """The same key within ``ttl`` (event time) is served once; state
    per key expires with the watermark."""
    return event_time(stream, ts).withWatermark(ts, ttl).dropDuplicatesWithinWatermark(list(keys))
