"""Readers for the parquet tables every query runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan; Catalyst prunes columns and pushes filters into it.

    A scan narrower than the cluster (one file with one row group is read by
    one task) is spread round-robin to ``defaultParallelism`` partitions so
    the row-level work after it uses every core; a wide scan — any real
    input at scale — is returned untouched (no extra shuffle)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    par = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        df = df.repartition(par)
    return df
