"""Session helpers: a tuned local session for tests/bench, and the
checkpoint folder lookup that every iterative operator uses."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Broadcast only what the planner has measured as small.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "quarry") -> SparkSession:
    """Local session for tests and the bench; on a cluster pass nothing and
    the cluster's own settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        for k, v in _DEFAULTS.items():
            b = b.config(k, v)
        b = b.config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEM", "16g"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points to a shared file system and is used
    as is.  Only when it is unset in local mode (tests) a scratch folder is
    made; on a cluster that is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss) into the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffles (and checkpoints, if so set) that nothing refers to any more:
    it does when the driver's garbage is collected, which large jobs of a small driver seldom cause."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir for written tables."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/quarry-{name}-{uuid.uuid4().hex[:12]}"


def shared_uri(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, with the scheme of the file system that Spark itself
    takes the shared folder's path to name: tasks write and read files of their own there by
    pyarrow."""
    import uuid

    p = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    base = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return re.sub(r"^file:/+", "file:///", base) + f"/{name}-{uuid.uuid4().hex[:12]}"
