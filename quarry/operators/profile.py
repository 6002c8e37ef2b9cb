"""Aggregations and profiling (F01–F13) and ordered / set operations
(W01–W04).  All are group-bys with map-side partial aggregation; ordered
results over whole tables use the range-partitioned kernels."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.bind import bind_stats
from ..functions.stats import distinct_value_ranks, global_running
from ..session import cut_lineage


# ---------------------------------------------------------------- F01 / F03
def group_frequency(df: DataFrame, key: Column | str, top_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """(top-n groups by count, summary row total/unique/diversity/top share)."""
    k = F.col(key) if isinstance(key, str) else key
    counts = df.groupBy(k.alias("group_key")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "group_key").limit(top_n)
    summ = counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_unique"), F.max("n").alias("top_count"))
    summ = summ.select("total", "n_unique", (F.col("n_unique") / F.col("total")).alias("diversity"),
                       (F.col("top_count") / F.col("total")).alias("top_share"))
    return top, summ


def diversity_notes(summary: DataFrame) -> DataFrame:
    """diversity bands (<0.1, <0.3, >0.7) and a dominance note (>30 %)."""
    d = F.col("diversity")
    band = F.when(d < 0.1, "very_low_diversity").when(d < 0.3, "low_diversity").when(d > 0.7, "high_diversity")
    return summary.select(F.array_compact(F.array(band, F.when(F.col("top_share") > 0.3, "dominant_group"))).alias("notes"))


# ---------------------------------------------------------------- F02 / F05
def first_match_category(text: Column, patterns: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """name of the first matching pattern, else ``other``."""
    expr = None
    for name, pat in patterns:
        expr = F.when(text.rlike(pat), F.lit(name)) if expr is None else expr.when(text.rlike(pat), F.lit(name))
    return expr.otherwise(F.lit(other)) if expr is not None else F.lit(other)


def pattern_prevalence(df: DataFrame, text: str, patterns: Sequence[tuple[str, str]],
                       dominant: float = 0.3) -> DataFrame:
    """share of rows matching each named pattern (one aggregate)."""
    one = df.agg(*[F.avg(F.col(text).rlike(p).cast("double")).alias(f"p{i}") for i, (_, p) in enumerate(patterns)])
    arr = F.array(*[F.struct(F.lit(n).alias("pattern"), F.col(f"p{i}").alias("prevalence"))
                    for i, (n, _) in enumerate(patterns)])
    return one.select(F.inline(arr)).withColumn("is_dominant", F.col("prevalence") >= dominant)


# ---------------------------------------------------------------- F04 / F06
def dataset_profile(df: DataFrame, cols: Sequence[str], valid: Column | None = None) -> DataFrame:
    """valid / invalid counts and mean, pop std, min, max per column
    over all rows (one aggregate; no 500-row sample)."""
    ok = valid if valid is not None else F.lit(True)
    aggs = [F.count_if(ok).alias("n_valid"), F.count_if(~ok).alias("n_invalid")]
    for c in cols:
        v = F.when(ok, F.col(c))
        aggs += [F.avg(v).alias(f"{c}_mean"), F.stddev_pop(v).alias(f"{c}_std"),
                 F.min(v).cast("double").alias(f"{c}_min"), F.max(v).cast("double").alias(f"{c}_max")]
    return df.agg(*aggs)


def profile_recommendations(profile: DataFrame, rules: Sequence[tuple[str, Column]],
                            default: str = "general") -> DataFrame:
    """codes of every rule that fires, else ``default``."""
    arr = F.array_compact(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]))
    return profile.select(F.when(F.size(arr) == 0, F.array(F.lit(default))).otherwise(arr).alias("recommendations"))


# ---------------------------------------------------------------- F07 / F08
def mixture_aggregate(components: DataFrame, mixture_id: str, key: str, ratio: str,
                      features: DataFrame, feature_key: str, feature_cols: Sequence[str]) -> DataFrame:
    """per mixture, ratios normalised by their total (total 0 → 1),
    Σ ratio·x per feature, n components, max / min / pop std of ratios,
    per-feature pop std when n > 1.  Components join their features on the
    key (shuffle or broadcast chosen by the planner from sizes)."""
    j = components.join(features.select(F.col(feature_key).alias(key), *feature_cols), key)
    s = j.groupBy(mixture_id).agg(
        F.sum(ratio).alias("__tot"), F.count(F.lit(1)).alias("n_components"),
        F.max(ratio).alias("__mx"), F.min(ratio).alias("__mn"), F.stddev_pop(ratio).alias("__sd"),
        *[F.sum(F.col(ratio) * F.col(c)).alias(f"__w_{c}") for c in feature_cols],
        *[F.stddev_pop(c).alias(f"__s_{c}") for c in feature_cols])
    norm = F.when(F.col("__tot") == 0, F.lit(1.0)).otherwise(F.col("__tot"))
    return s.select(mixture_id, "n_components",
                    (F.col("__mx") / norm).alias("max_ratio"), (F.col("__mn") / norm).alias("min_ratio"),
                    (F.col("__sd") / norm).alias("std_ratio"),
                    *[(F.col(f"__w_{c}") / norm).alias(f"{c}_weighted") for c in feature_cols],
                    *[F.when(F.col("n_components") > 1, F.col(f"__s_{c}")).otherwise(F.lit(0.0)).alias(f"{c}_std")
                      for c in feature_cols])


def mixture_wide(df: DataFrame, row_id: str, pairs: Sequence[tuple[str, str]], features: DataFrame,
                 feature_key: str, feature_cols: Sequence[str], default_key=None) -> DataFrame:
    """wide key_i / ratio_i pairs stacked to long (null ratio → 0,
    blank key → default), joined to features, Σ ratio·x per row — not
    normalised."""
    arr = F.array(*[F.struct(F.col(k).alias("k"), F.col(r).alias("r")) for k, r in pairs])
    lg = df.select(row_id, F.inline(arr)).select(
        row_id, F.coalesce(F.col("k"), F.lit(default_key)).alias("k"), F.coalesce(F.col("r"), F.lit(0.0)).alias("r"))
    j = lg.join(features.select(F.col(feature_key).alias("k"), *feature_cols), "k")
    return j.groupBy(row_id).agg(*[F.sum(F.col("r") * F.col(c)).alias(f"{c}_mix") for c in feature_cols])


# ---------------------------------------------------------------- F09
def cluster_stats(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """size, mean and sample std per cluster and feature (long form)."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols])
    lg = df.select(label, F.inline(arr))
    return lg.groupBy(label, "feature").agg(F.count("x").alias("size"), F.avg("x").alias("mean"),
                                            F.stddev_samp("x").alias("std"))


# ---------------------------------------------------------------- F10
def top_variance_columns(df: DataFrame, cols: Sequence[str], max_features: int | None = None) -> list[str]:
    """all columns, or the ``max_features`` of largest (sample) variance if a
    number is asked for."""
    if max_features is None or len(cols) <= max_features:
        return list(cols)
    v = df.agg(*[F.var_samp(c).alias(c) for c in cols]).first()
    return sorted(cols, key=lambda c: (-(v[c] or 0.0), c))[:max_features]


def average_ranks(df: DataFrame, key_cols: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Replace each column by its average rank (ties share the mean rank),
    computed over distinct values and joined back on the value."""
    out = df.select(*key_cols, *cols)
    for c in cols:
        r = distinct_value_ranks(df.select(F.col(c).alias("__v")).where(F.col("__v").isNotNull()), "__v", [])
        r = r.select(F.col("__v").alias(c), (F.col("__before") + (F.col("__cnt") + 1) / 2).alias(f"__r_{c}"))
        out = out.join(r, c, "left").drop(c).withColumnRenamed(f"__r_{c}", c)
    return out


def correlation_matrix(df: DataFrame, cols: Sequence[str], method: str = "pearson",
                       key_cols: Sequence[str] = ()) -> DataFrame:
    """full symmetric matrix in long form (col_a, col_b, corr); spearman =
    pearson over average ranks, kendall = τ-b."""
    if method == "kendall":
        return kendall_matrix(df, cols)
    x = average_ranks(df, key_cols, cols) if method == "spearman" else df
    pairs = [(a, b) for a in cols for b in cols]
    one = x.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"),
                                                  F.col(f"p{i}").alias("corr")) for i, (a, b) in enumerate(pairs)])))


#: Ranges of each axis that discordant pairs are counted between, at most.
KENDALL_RANGES = 512


def inversions(value: np.ndarray, weight: np.ndarray) -> int:
    """Σ of weight products over i < j with value[i] > value[j], bit by bit: of
    values that agree in the higher bits, ones before zeros are inverted."""
    _, v = np.unique(value, return_inverse=True)
    w = weight.astype(object) if float(weight.sum()) ** 2 > 2.0 ** 62 else weight.astype(np.int64)
    total = 0
    for bit in range(int(v.max()).bit_length() - 1 if len(v) else -1, -1, -1):
        order = np.argsort(v >> (bit + 1), kind="stable")
        v, w = v[order], w[order]
        one = (v >> bit) & 1
        before = np.cumsum(w * one) - w * one
        group = v >> (bit + 1)
        first = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, np.arange(len(v)), 0))
        total += int((w * (1 - one) * (before - before[first])).sum())
    return total


def kendall(df: DataFrame, a: str, b: str) -> float | None:
    """τ-b of two numeric columns over the rows that have both; None without
    rows or if a column is constant.

    Discordant pairs are inversions of the order by (a, b) against that by (b, a), which
    count no tie.  Different (a, b) are cut into ranges along both orders: pairs
    that differ in both ranges are counted on the table of cells, the others inside
    their range of one axis, a task a range; pairs in one cell, which both axes
    have, are taken off once.  Only the table of cells, KENDALL_RANGES squared at most,
    comes to the driver."""
    x = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"))
    x = x.where(~(F.isnan("x") | F.isnan("y"))).groupBy("x", "y").agg(F.count("*").alias("w")).where("x is not null and y is not null")
    x = cut_lineage(x)

    def ties(c):
        g = x.groupBy(c).agg(F.sum("w").cast("decimal(38,0)").alias("t"))
        return int(g.agg(F.sum(F.col("t") * (F.col("t") - 1))).first()[0] or 0) // 2

    n = int(x.agg(F.sum("w")).first()[0] or 0)
    pairs, tie_x, tie_y = n * (n - 1) // 2, ties("x"), ties("y")
    if pairs == 0 or tie_x == pairs or tie_y == pairs:
        return None
    tie_both = int(x.agg(F.sum(F.col("w").cast("decimal(19,0)") * (F.col("w") - 1))).first()[0] or 0) // 2
    ranges = min(KENDALL_RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = x.repartitionByRange(ranges, "x", "y").withColumn("p", F.spark_partition_id())
    placed = cut_lineage(cut_lineage(placed).repartitionByRange(ranges, "y", "x").withColumn("r", F.spark_partition_id()))
    cells = np.zeros((ranges, ranges), object)
    for c in placed.groupBy("p", "r").agg(F.sum("w").alias("w")).collect():
        cells[c["p"], c["r"]] = int(c["w"])
    # Cells above and to the left: earlier in the first order, later in the second.
    later = np.cumsum(cells[:, ::-1], axis=1)[:, ::-1]
    before = np.cumsum(later, axis=0)
    discordant = int((cells[1:, :-1] * before[:-1, 1:]).sum()) if ranges > 1 else 0

    def inside(axis: str, cell: str):
        def run(table: pa.Table) -> pa.Table:
            t = table.sort_by([("x", "ascending"), ("y", "ascending")])
            x_, y_, w, c = (t.column(k).to_numpy() for k in ("x", "y", "w", cell))
            rank = np.empty(len(y_), np.int64)
            rank[np.lexsort((x_, y_))] = np.arange(len(y_))
            found = inversions(rank, w)
            own = np.argsort(c, kind="stable")  # by cell: no inversion between cells of a range
            within = inversions(rank[own] + (c[own].astype(np.int64) << 40), w[own])
            return pa.table({"d": pa.array([str(found - within if axis == "p" else found)], pa.string())})
        return placed.groupBy(axis).applyInArrow(run, "d string").agg(F.sum(F.col("d").cast("decimal(38,0)"))).first()[0]

    discordant += int(inside("p", "r") or 0) + int(inside("r", "p") or 0)
    concordant = pairs - tie_x - tie_y + tie_both - discordant
    t = (concordant - discordant) / (math.sqrt(pairs - tie_x) * math.sqrt(pairs - tie_y))
    return max(-1.0, min(1.0, t))


def kendall_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(col_a, col_b, corr): τ-b of all pairs of columns; a row per pair of columns."""
    rows = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            t = kendall(df, a, b)
            rows += [(a, b, t)] + ([(b, a, t)] if a != b else [])
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


# ---------------------------------------------------------------- F11
def histograms(df: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """equal-width histogram per column between its min and max."""
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("x")) for c in cols])
    lg = df.select(F.inline(arr)).where(F.col("x").isNotNull())
    mm = lg.groupBy("column_name").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = lg.join(F.broadcast(mm), "column_name")
    width = F.col("hi") - F.col("lo")
    b = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) / width * bins), F.lit(bins - 1)))
    return j.groupBy("column_name", b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- F12
def leaderboard(metrics_long: DataFrame, run: str, metric: str, value: str,
                rank_metric: str = "r2") -> DataFrame:
    """runs × metrics pivot (metric names discovered by one distinct
    pass over the small metrics table), rank by ``rank_metric`` with
    missing = 0; best-score column follows r2 → accuracy → 0."""
    names = sorted(r[0] for r in metrics_long.select(metric).distinct().collect())
    wide = metrics_long.groupBy(run).pivot(metric, names).agg(F.first(value))
    best = F.coalesce(*[F.col(c) for c in ("r2", "accuracy") if c in names], F.lit(0.0))
    score = F.coalesce(F.col(rank_metric), F.lit(0.0)) if rank_metric in names else F.lit(0.0)
    return wide.withColumn("best_score", best).withColumn("rank", F.rank().over(W.orderBy(F.desc(score), run)))


# ---------------------------------------------------------------- F13
def timing_report(df: DataFrame, name: str, duration: str) -> DataFrame:
    """per name total, calls, avg and share of the grand total, desc."""
    g = df.groupBy(name).agg(F.sum(duration).alias("total"), F.count(F.lit(1)).alias("calls"),
                             F.avg(duration).alias("avg"))
    grand = g.agg(F.sum("total").alias("grand"))
    return bind_stats(g, grand, "_g").select(name, "total", "calls", "avg",
                                             (F.col("total") / F.col("_g.grand")).alias("share")).orderBy(F.desc("total"))


# ---------------------------------------------------------------- W01–W04
def top_k_per_group(df: DataFrame, group: str, score: str, k: int, tie: str) -> DataFrame:
    """row_number per group ≤ k; Spark plans a WindowGroupLimit before
    the shuffle so a hot group ships only k rows per map task."""
    w = W.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def components_for_variance(variances: DataFrame, idx: str, var: str, target: float = 0.95) -> DataFrame:
    """Cumulative explained-variance share → first index reaching target
    (the variance table is one row per component: tiny)."""
    w = W.orderBy(idx).rowsBetween(W.unboundedPreceding, 0)
    x = variances.withColumn("cum_share", F.sum(var).over(w) / F.sum(var).over(W.partitionBy()))
    return x.where(F.col("cum_share") >= target).agg(F.min(idx).alias("first_idx")).select(
        (F.col("first_idx") + 1).alias("n_components"))


def union_rows(*dfs: DataFrame) -> DataFrame:
    """Concatenate batches by column name (missing columns → null)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def remaining(pool: DataFrame, taken: DataFrame, key: str) -> DataFrame:
    """Rows of ``pool`` whose key is not in ``taken`` (anti join)."""
    return pool.join(taken.select(key), key, "left_anti")


def best_so_far(df: DataFrame, order_col: str, value: str, minimize: bool = True) -> DataFrame:
    """Running best of a metric history over the whole table."""
    return global_running(df, [order_col], value, "min" if minimize else "max", "best_so_far")
