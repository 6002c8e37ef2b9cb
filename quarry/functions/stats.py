"""Reusable aggregate kernels.

``quantiles`` computes exact linear-interpolated quantiles (NumPy "linear",
DuckDB ``quantile_cont``) for many columns at once *without* funnelling a
column into one task: values are counted per distinct value (partial
aggregation), range-partitioned, prefix-summed per partition, and only the
few rows that hold the wanted ranks are kept.  The result is a tiny table
(columns × probabilities) that is safe to broadcast.  ``approx=True``
switches to ``percentile_approx`` (one pass, bounded memory, rank error
≤ n/accuracy).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage


def long_values(df: DataFrame, cols: Sequence[str], name_col: str = "column_name",
                value_col: str = "v") -> DataFrame:
    """Unpivot numeric columns to (column_name, v) with NaN/null dropped."""
    arr = F.array(*[F.struct(F.lit(c).alias(name_col), F.col(c).cast("double").alias(value_col))
                    for c in cols])
    return (df.select(F.inline(arr))
            .where(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col))))


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              approx: bool = False, accuracy: int = 10000,
              num_ranges: int | None = None) -> DataFrame:
    """Return (column_name, p, q) for every column and probability."""
    probs = [float(p) for p in probs]
    if approx:
        agg = df.agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c)
                       for c in cols])
        parts = [agg.select(F.lit(c).alias("column_name"),
                            F.posexplode(F.col(c)).alias("i", "q")) for c in cols]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        ptab = df.sparkSession.createDataFrame([(i, p) for i, p in enumerate(probs)], "i int, p double")
        return out.join(F.broadcast(ptab), "i").select("column_name", "p", "q")

    spark = df.sparkSession
    if num_ranges is None:
        num_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vc = (long_values(df, cols).groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("cnt"))
          .repartitionByRange(num_ranges, "column_name", "v")
          .withColumn("pid", F.spark_partition_id()))
    # the range assignment must be seen identically by both branches below,
    # so it is materialised once (reliable checkpoint, survives executor loss)
    vc = cut_lineage(vc)
    # per (range, column) totals: at most num_ranges × #columns rows
    tot = vc.groupBy("pid", "column_name").agg(F.sum("cnt").alias("tot"))
    w_off = W.partitionBy("column_name").orderBy("pid").rowsBetween(W.unboundedPreceding, -1)
    offs = (tot.withColumn("off", F.coalesce(F.sum("tot").over(w_off), F.lit(0)))
            .withColumn("n", F.sum("tot").over(W.partitionBy("column_name"))))
    ptab = spark.createDataFrame([(p,) for p in probs], "p double")
    # wanted 0-based ranks per column and p: lo=floor(h), hi=ceil(h), h=(n-1)p
    ranks = (offs.select("column_name", "n").distinct().crossJoin(F.broadcast(ptab))
             .withColumn("h", (F.col("n") - 1) * F.col("p"))
             .withColumn("lo", F.floor("h").cast("bigint"))
             .withColumn("hi", F.ceil("h").cast("bigint")))
    need = (ranks.select("column_name", "p", F.col("lo").alias("r"), F.lit("lo").alias("side"))
            .unionByName(ranks.select("column_name", "p", F.col("hi").alias("r"), F.lit("hi").alias("side"))))
    w_cum = W.partitionBy("pid", "column_name").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    cum = (vc.join(F.broadcast(offs.select("pid", "column_name", "off")), ["pid", "column_name"])
           .withColumn("cum", F.col("off") + F.sum("cnt").over(w_cum)))
    # the range that holds each wanted rank: 2 × probabilities × columns rows
    place = (offs.join(F.broadcast(need), "column_name")
             .where((F.col("r") >= F.col("off")) & (F.col("r") < F.col("off") + F.col("tot")))
             .select("pid", "column_name", "p", "r", "side"))
    hit = (cum.join(F.broadcast(place), ["pid", "column_name"])
           .where((F.col("r") >= F.col("cum") - F.col("cnt")) & (F.col("r") < F.col("cum")))
           .groupBy("column_name", "p")
           .agg(F.max(F.when(F.col("side") == "lo", F.col("v"))).alias("x_lo"),
                F.max(F.when(F.col("side") == "hi", F.col("v"))).alias("x_hi")))
    return (hit.join(F.broadcast(ranks.select("column_name", "p", "h", "lo")), ["column_name", "p"])
            .select("column_name", "p",
                    (F.col("x_lo") + (F.col("h") - F.col("lo")) * (F.col("x_hi") - F.col("x_lo"))).alias("q")))


def quantile_row(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                 approx: bool = False, names: Sequence[str] | None = None) -> DataFrame:
    """One-row frame with a column per (col, p): ``{col}__q{idx}``."""
    q = quantiles(df, cols, probs, approx=approx)
    exprs = []
    for c in cols:
        for i, p in enumerate(probs):
            exprs.append(F.max(F.when((F.col("column_name") == c) & (F.col("p") == float(p)),
                                      F.col("q"))).alias(f"{c}__q{i}"))
    return q.agg(*exprs)


def global_rank(df: DataFrame, order_cols: Sequence[str], partition_cols: Sequence[str] = (),
                weight_col: str | None = None, num_ranges: int | None = None) -> DataFrame:
    """Row number (1-based, ``__rn``), inclusive running weight (``__cum``),
    group size (``__n``) and group weight (``__wt``) within ``partition_cols``
    ordered by ``order_cols`` — without a single-task window.

    Rows are range-partitioned on (partition, order) keys, each range counts
    its rows per group (a table of ranges × groups), offsets are prefix sums
    over that small table, and the final row_number runs per range.  A hot
    group (one class holding a third of the rows) spreads over many ranges.
    ``order_cols`` must make the order total (end with a unique id)."""
    spark = df.sparkSession
    if num_ranges is None:
        num_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pc = list(partition_cols)
    w = F.col(weight_col).cast("double") if weight_col else F.lit(1.0)
    x = cut_lineage(df.withColumn("__w", w).repartitionByRange(num_ranges, *pc, *order_cols)
                    .withColumn("__pid", F.spark_partition_id()))
    tot = x.groupBy("__pid", *pc).agg(F.count(F.lit(1)).alias("__c"), F.sum("__w").alias("__s"))
    wo = W.partitionBy(*pc).orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)
    wall = W.partitionBy(*pc)
    offs = tot.select("__pid", *pc,
                      F.coalesce(F.sum("__c").over(wo), F.lit(0)).alias("__off"),
                      F.coalesce(F.sum("__s").over(wo), F.lit(0.0)).alias("__soff"),
                      F.sum("__c").over(wall).alias("__n"), F.sum("__s").over(wall).alias("__wt"))
    wl = W.partitionBy("__pid", *pc).orderBy(*order_cols)
    wc = wl.rowsBetween(W.unboundedPreceding, 0)
    return (x.join(F.broadcast(offs), ["__pid", *pc])
            .withColumn("__rn", F.col("__off") + F.row_number().over(wl))
            .withColumn("__cum", F.col("__soff") + F.sum("__w").over(wc))
            .drop("__pid", "__off", "__soff", "__w"))


def ntile_of(rn0: "F.Column", n: "F.Column", k: int) -> "F.Column":
    """SQL ``ntile(k)`` bucket (1-based) for a 0-based rank ``rn0`` of ``n`` rows."""
    q = F.floor(n / k)
    rem = n - q * k
    big = rem * (q + 1)
    return (F.when(rn0 < big, F.floor(rn0 / (q + 1)))
            .otherwise(rem + F.floor((rn0 - big) / F.greatest(q, F.lit(1)))) + 1).cast("int")


def grouped_quantile(df: DataFrame, value: str, group_cols: Sequence[str], p: float,
                     out: str = "q") -> DataFrame:
    """Exact linear-interpolated quantile of ``value`` per group, using
    ``global_rank`` (no group is ever gathered into one task)."""
    x = df.where(F.col(value).isNotNull()).select(*group_cols, F.col(value).cast("double").alias("__v"))
    r = global_rank(x, ["__v"], group_cols)
    h = (F.col("__n") - 1) * F.lit(p)
    lo = F.floor(h) + 1
    hi = F.ceil(h) + 1
    sel = r.where((F.col("__rn") == lo) | (F.col("__rn") == hi))
    return sel.groupBy(*group_cols).agg(
        F.max(F.when(F.col("__rn") == lo, F.col("__v"))).alias("__lo"),
        F.max(F.when(F.col("__rn") == hi, F.col("__v"))).alias("__hi"),
        F.first(h).alias("__h")).select(
        *group_cols, (F.col("__lo") + (F.col("__h") - F.floor("__h")) * (F.col("__hi") - F.col("__lo"))).alias(out))


def distinct_value_ranks(df: DataFrame, value: str, flag_cols: Sequence[str]) -> DataFrame:
    """Group rows by distinct ``value`` with per-flag counts, then attach
    the cumulative row count before each value (ascending) — the basis of
    exact rank statistics (AUC, Mann–Whitney, average precision).  The
    running sum runs on the distinct-value table via ``global_rank``."""
    g = df.groupBy(value).agg(F.count(F.lit(1)).alias("__cnt"),
                              *[F.sum(F.col(c).cast("long")).alias(c) for c in flag_cols])
    r = global_rank(g, [value], weight_col="__cnt")
    return r.withColumn("__before", F.col("__cum") - F.col("__cnt")).drop("__rn")


def global_running(df: DataFrame, order_cols: Sequence[str], value_col: str, fn: str = "min",
                   out: str = "running", num_ranges: int | None = None) -> DataFrame:
    """Running min / max / sum of ``value_col`` over the whole table in
    ``order_cols`` order without a single-task window: per-range totals,
    prefix over the (small) range table, then a local running value."""
    spark = df.sparkSession
    if num_ranges is None:
        num_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    agg = {"min": F.min, "max": F.max, "sum": F.sum}[fn]
    x = cut_lineage(df.repartitionByRange(num_ranges, *order_cols).withColumn("__pid", F.spark_partition_id()))
    tot = x.groupBy("__pid").agg(agg(value_col).alias("__t"))
    prev = tot.withColumn("__prev", agg("__t").over(W.orderBy("__pid").rowsBetween(W.unboundedPreceding, -1)))
    local = agg(value_col).over(W.partitionBy("__pid").orderBy(*order_cols).rowsBetween(W.unboundedPreceding, 0))
    y = x.join(F.broadcast(prev.select("__pid", "__prev")), "__pid").withColumn("__loc", local)
    if fn == "sum":
        comb = F.coalesce(F.col("__prev"), F.lit(0)) + F.col("__loc")
    elif fn == "min":
        comb = F.least(F.col("__prev"), F.col("__loc"))
    else:
        comb = F.greatest(F.col("__prev"), F.col("__loc"))
    return y.withColumn(out, comb).drop("__pid", "__prev", "__loc")
