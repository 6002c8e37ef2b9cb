"""Data-quality profiling and cleaning (missing, duplicates, outliers,
constant columns, correlated pairs, scores, recommendations, clean).

Every profile is one or two aggregates over the table; nothing is
collected.  Quantiles come from the distributed exact kernel in
``quarry.functions.stats``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bind import bind_stats
from ..functions.columns import is_missing, numeric_columns
from ..functions.stats import quantiles


def _stack(one_row: DataFrame, cols: Sequence[str], value_names: Sequence[str],
           carry: Sequence[str] = ()) -> DataFrame:
    """One-row frame with ``{c}__{v}`` columns → long (column_name, v...);
    ``carry`` columns of the row are repeated on every output row."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             *[F.col(f"{c}__{v}").alias(v) for v in value_names],
                             *[F.col(k).alias(k) for k in carry]) for c in cols])
    return one_row.select(F.inline(arr))


# ---------------------------------------------------------------- C01 / C02
def missing_by_column(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column_name, missing_count, missing_rate, dtype) for every column."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        aggs.append(F.count_if(is_missing(c, df.schema[c].dataType)).cast("bigint").alias(f"{c}__missing_count"))
    one = df.agg(*aggs)
    for c in cols:
        one = one.withColumn(f"{c}__dtype", F.lit(df.schema[c].dataType.simpleString()))
    long = _stack(one, cols, ["missing_count", "dtype"], carry=["__n"])
    return long.select(
        "column_name", "missing_count",
        F.when(F.col("__n") > 0, F.col("missing_count") / F.col("__n")).otherwise(F.lit(0.0)).alias("missing_rate"),
        "dtype")


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns that have any missing cell, with count and rate."""
    return missing_by_column(df, cols).where("missing_count > 0").drop("dtype")


def missing_summary(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing columns only, sorted by rate desc (then name)."""
    return (missing_by_column(df, cols).where("missing_count > 0")
            .orderBy(F.desc("missing_rate"), "column_name"))


def missing_totals(df: DataFrame) -> DataFrame:
    """Total missing cells and their share of all cells."""
    cells = F.lit(0)
    for c in df.columns:
        cells = cells + F.count_if(is_missing(c, df.schema[c].dataType))
    n = F.count(F.lit(1))
    ncols = len(df.columns)
    return df.agg(n.alias("n_samples"), cells.cast("bigint").alias("missing_count")).select(
        "n_samples", F.lit(ncols).alias("n_features"), "missing_count",
        F.when(F.col("n_samples") * ncols > 0, F.col("missing_count") / (F.col("n_samples") * ncols))
        .otherwise(F.lit(0.0)).alias("missing_percent"))


# ---------------------------------------------------------------- C03 / C04
def duplicate_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows beyond the first of each identical group (null equals null).
    The group-by is partially aggregated map-side, so a hot duplicate group
    costs one counter per partition, not a skewed task."""
    cols = list(cols or df.columns)
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__c"))
    return g.agg(F.sum("__c").cast("bigint").alias("n_rows"),
                 F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows")).select(
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "duplicate_rows",
        F.when(F.col("n_rows") > 0, F.col("duplicate_rows") / F.col("n_rows")).otherwise(F.lit(0.0))
        .alias("duplicate_percent"))


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Number of distinct key values that occur more than once."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__c"))
    return g.agg(F.count_if(F.col("__c") > 1).cast("bigint").alias("duplicate_keys"),
                 F.coalesce(F.sum(F.when(F.col("__c") > 1, F.col("__c") - 1)), F.lit(0)).cast("bigint")
                 .alias("duplicate_occurrences"))


# ---------------------------------------------------------------- C05 / C06
def iqr_bounds(df: DataFrame, cols: Sequence[str], threshold: float = 1.5,
               approx: bool = False) -> DataFrame:
    """(column_name, q1, q3, lower, upper) with linear-interpolated quartiles."""
    q = quantiles(df, cols, [0.25, 0.75], approx=approx)
    b = q.groupBy("column_name").agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    return b.select("column_name", "q1", "q3",
                    (F.col("q1") - threshold * (F.col("q3") - F.col("q1"))).alias("lower"),
                    (F.col("q3") + threshold * (F.col("q3") - F.col("q1"))).alias("upper"))


def _bounds_row(bounds: DataFrame, cols: Sequence[str]) -> DataFrame:
    return bounds.agg(*[F.max(F.when(F.col("column_name") == c, F.struct("lower", "upper"))).alias(c)
                        for c in cols])


def outliers_iqr(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 1.5,
                 approx: bool = False) -> DataFrame:
    """Per numeric column, values strictly outside [Q1−t·IQR, Q3+t·IQR]."""
    cols = list(cols or numeric_columns(df))
    bounds = iqr_bounds(df, cols, threshold, approx)
    b = bind_stats(df.select(*cols), _bounds_row(bounds, cols), "_b")
    aggs = []
    for c in cols:
        v = F.col(c).cast("double")
        aggs.append(F.count_if((v < F.col(f"_b.{c}.lower")) | (v > F.col(f"_b.{c}.upper")))
                    .cast("bigint").alias(f"{c}__outlier_count"))
    return _stack(b.agg(*aggs), cols, ["outlier_count"])


def outliers_zscore(df: DataFrame, cols: Sequence[str] | None = None,
                    threshold: float = 3.0) -> DataFrame:
    """|x − mean| / std_pop > t per column (std 0 → no outliers)."""
    cols = list(cols or numeric_columns(df))
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols])
    b = bind_stats(df.select(*cols), stats, "_z")
    aggs = []
    for c in cols:
        z = F.abs(F.col(c) - F.col(f"_z.{c}.m")) / F.col(f"_z.{c}.s")
        aggs.append(F.count_if((F.col(f"_z.{c}.s") > 0) & (z > threshold))
                    .cast("bigint").alias(f"{c}__outlier_count"))
    return _stack(b.agg(*aggs), cols, ["outlier_count"])


# ---------------------------------------------------------------- C07 / C08
def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Columns with at most one distinct non-null value.  ``min <=> max``
    answers it in one pass with no distinct shuffle."""
    cols = list(cols or df.columns)
    one = df.agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"),
                             F.col(f"{c}.lo").eqNullSafe(F.col(f"{c}.hi")).alias("is_constant"))
                    for c in cols])
    return one.select(F.inline(arr)).where("is_constant").select("column_name")


def correlation_long(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Upper-triangle Pearson matrix in long form (col_a, col_b, corr) from
    one aggregate (every pair's corr is a mergeable partial aggregate)."""
    cols = list(cols or numeric_columns(df))
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, corr double")
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}")
                   for i, (a, b) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"p{i}").alias("corr"))
                    for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(arr))


def high_correlation(df: DataFrame, cols: Sequence[str] | None = None,
                     threshold: float = 0.95) -> DataFrame:
    """Pairs with |r| > threshold over the upper triangle."""
    return (correlation_long(df, cols).select("col_a", "col_b", F.abs("corr").alias("abs_corr"))
            .where(F.col("abs_corr") > threshold))


# ---------------------------------------------------------------- C09 / C11
def quality_report(df: DataFrame, outlier_method: str = "iqr", outlier_threshold: float = 1.5,
                   correlation_threshold: float = 0.95, missing_threshold: float = 0.5,
                   approx: bool = False) -> DataFrame:
    """C09 + C11: one-row scorecard (score 0–100) with recommendation codes.

    Passes over the table: one profile aggregate (missing counts, min/max for
    constancy, all pairwise corr), one duplicate group-by, and the outlier
    pass (quantile kernel + one count)."""
    num = numeric_columns(df)
    cols = df.columns
    n_num, nfeat = len(num), len(cols)
    pairs = [(a, b) for i, a in enumerate(num) for b in num[i + 1:]]
    aggs = [F.count(F.lit(1)).alias("n_samples")]
    for k, c in enumerate(cols):
        aggs.append(F.count_if(is_missing(c, df.schema[c].dataType)).alias(f"m{k}"))
        aggs.append(F.min(c).eqNullSafe(F.max(c)).alias(f"k{k}"))
    for k, (a, b) in enumerate(pairs):
        aggs.append(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{k}"))
    prof = df.agg(*aggs)
    miss_total = sum((F.col(f"m{k}") for k in range(nfeat)), F.lit(0)).cast("bigint")
    hi_missing = sum((F.when(F.col(f"m{k}") > F.col("n_samples") * missing_threshold, 1).otherwise(0)
                      for k in range(nfeat)), F.lit(0))
    n_const = sum((F.col(f"k{k}").cast("int") for k in range(nfeat)), F.lit(0))
    n_corr = sum((F.when(F.abs(F.col(f"r{k}")) > correlation_threshold, 1).otherwise(0)
                  for k in range(len(pairs))), F.lit(0))
    row = prof.select(
        "n_samples", F.lit(nfeat).alias("n_features"), miss_total.alias("missing_count"),
        F.when(F.col("n_samples") > 0, miss_total / (F.col("n_samples") * F.lit(max(nfeat, 1))))
        .otherwise(F.lit(0.0)).alias("missing_percent"),
        n_const.cast("bigint").alias("constant_columns"), n_corr.cast("bigint").alias("correlated_pairs"),
        hi_missing.cast("bigint").alias("high_missing_columns"))
    dup = duplicate_rows(df).select("duplicate_rows", "duplicate_percent")
    if num:
        out = (outliers_iqr(df, num, outlier_threshold, approx) if outlier_method == "iqr"
               else outliers_zscore(df, num, outlier_threshold))
        out1 = out.agg(F.coalesce(F.sum("outlier_count"), F.lit(0)).cast("bigint").alias("outlier_count"))
    else:
        out1 = df.sparkSession.createDataFrame([(0,)], "outlier_count bigint")
    for other in (dup, out1):
        row = bind_stats(row, other, "_o").select(*row.columns, *[F.col(f"_o.{c}").alias(c) for c in other.columns])
    outlier_pct = F.when(F.col("n_samples") * n_num > 0,
                         F.col("outlier_count") / (F.col("n_samples") * F.lit(n_num))).otherwise(F.lit(0.0))
    row = row.withColumn("outlier_percent", outlier_pct)
    const_pct = F.col("constant_columns") / F.lit(max(nfeat, 1))
    score = (F.lit(100.0) - (F.col("missing_percent") * 50 + F.col("duplicate_percent") * 30
                             + F.col("outlier_percent") * 20 + const_pct * 10))
    row = row.withColumn("overall_score", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    recs = F.array_compact(F.array(
        F.when(F.col("high_missing_columns") > 0, F.lit("drop_high_missing_columns")),
        F.when(F.col("duplicate_percent") > 0.01, F.lit("drop_duplicates")),
        F.when(F.col("constant_columns") > 0, F.lit("drop_constant_columns")),
        F.when(F.col("correlated_pairs") > 0, F.lit("reduce_correlated_pairs"))))
    return row.withColumn("recommendations",
                          F.when(F.size(recs) == 0, F.array(F.lit("quality_good"))).otherwise(recs))


def quality_score_b(valid_ratio: F.Column, dup_ratio: F.Column, outlier_ratio: F.Column) -> F.Column:
    """100 − 30·(1−validity) − 20·dup − 10·outlier, floored at 0."""
    return F.greatest(F.lit(0.0), F.lit(100.0) - (F.lit(1.0) - valid_ratio) * 30
                      - dup_ratio * 20 - outlier_ratio * 10)


# ---------------------------------------------------------------- C12
def clean_rows(df: DataFrame, key: str, order_col: str, valid: F.Column | None = None,
               remove_duplicates: bool = True, value_col: str | None = None,
               remove_outliers: bool = False, threshold: float = 1.5) -> DataFrame:
    """Keep valid rows, first of each duplicate key (by ``order_col``),
    optionally drop IQR outliers of ``value_col``; every mask is computed on
    the original rows."""
    out = df
    if valid is not None:
        out = out.withColumn("__valid", valid)
    else:
        out = out.withColumn("__valid", F.lit(True))
    if remove_duplicates:
        # first row per key via a partially aggregated min, joined back on
        # (key, order) so a hot key's rows hash to many partitions
        firsts = df.groupBy(key).agg(F.min(order_col).alias(order_col)).withColumn("__first", F.lit(True))
        out = out.join(firsts, [key, order_col], "left").withColumn(
            "__first", F.coalesce(F.col("__first"), F.lit(False)))
    else:
        out = out.withColumn("__first", F.lit(True))
    keep = F.col("__valid") & F.col("__first")
    if remove_outliers and value_col:
        b = iqr_bounds(df, [value_col], threshold).select("lower", "upper")
        out = bind_stats(out, b, "_b")
        v = F.col(value_col)
        keep = keep & ~((v < F.col("_b.lower")) | (v > F.col("_b.upper"))).eqNullSafe(True)
        out = out.where(keep).drop("_b")
    else:
        out = out.where(keep)
    return out.drop("__valid", "__first")
