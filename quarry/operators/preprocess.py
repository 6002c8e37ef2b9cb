"""Preprocessing (G01–G18).  Every ``fit_*`` returns a one-row statistics
DataFrame (lazy, computed once as a scalar subquery); every ``apply_*`` is a
pure projection, so transforms stay inside whole-stage codegen."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bind import bind_stats
from ..functions.columns import hash_u32, hash_unit, is_missing
from ..functions.stats import quantiles


def _qrow(df: DataFrame, cols: Sequence[str], probs: Sequence[float], approx: bool = False) -> DataFrame:
    """One-row frame: struct per column with fields q0, q1, ... (exact kernel)."""
    q = quantiles(df, cols, probs, approx=approx)
    return q.agg(*[F.struct(*[F.max(F.when((F.col("column_name") == c) & (F.col("p") == float(p)), F.col("q"))).alias(f"q{i}")
                              for i, p in enumerate(probs)]).alias(c) for c in cols])


# ---------------------------------------------------------------- G01 / G02 / G05
def fit_imputer(df: DataFrame, cols: Sequence[str], strategy: str = "mean", fill_value: float = 0.0) -> DataFrame:
    """Mean / median / most_frequent (ties → smallest) / constant."""
    if strategy == "mean":
        return df.agg(*[F.avg(c).alias(c) for c in cols])
    if strategy == "median":
        q = _qrow(df, cols, [0.5])
        return q.select(*[F.col(f"{c}.q0").alias(c) for c in cols])
    if strategy == "most_frequent":
        arr = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in cols])
        lg = df.select(F.inline(arr)).where(F.col("v").isNotNull())
        counts = lg.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
        mode = counts.groupBy("column_name").agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("m"))
        return mode.agg(*[F.max(F.when(F.col("column_name") == c, F.col("m"))).alias(c) for c in cols])
    if strategy == "constant":
        return df.sparkSession.range(1).select(*[F.lit(float(fill_value)).alias(c) for c in cols])
    raise ValueError(strategy)


def apply_imputer(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    x = bind_stats(df, stats, "_imp")
    return x.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_imp.{c}")) for c in cols}).drop("_imp")


def impute_method_choice(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column missing rate → simple (≤ 10 %), knn (> 10 %), iterative (> 30 %)."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(is_missing(c, df.schema[c].dataType)).alias(c) for c in cols])
    arr = F.array(*[F.struct(F.lit(c).alias("column_name"), (F.col(c) / F.col("n")).alias("missing_rate")) for c in cols])
    x = one.select(F.inline(arr))
    m = F.col("missing_rate")
    return x.withColumn("method", F.when(m > 0.3, "iterative").when(m > 0.1, "knn").otherwise("simple"))


def missing_indicators(df: DataFrame, fitted_missing_cols: Sequence[str]) -> DataFrame:
    """``missing_<c>`` 0/1 for the columns that had missing values at fit."""
    return df.withColumns({f"missing_{c}": F.col(c).isNull().cast("int") for c in fitted_missing_cols})


def columns_with_missing(df: DataFrame, cols: Sequence[str]) -> list[str]:
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] > 0]


# ---------------------------------------------------------------- G06
def fit_clip(df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """(lower, upper) per column by iqr / zscore (pop std, 0 → 1) / percentile 1–99."""
    if method == "iqr":
        q = _qrow(df, cols, [0.25, 0.75])
        return q.select(*[F.struct((F.col(f"{c}.q0") - threshold * (F.col(f"{c}.q1") - F.col(f"{c}.q0"))).alias("lo"),
                                   (F.col(f"{c}.q1") + threshold * (F.col(f"{c}.q1") - F.col(f"{c}.q0"))).alias("hi")).alias(c)
                          for c in cols])
    if method == "zscore":
        s = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c) for c in cols])
        sd = lambda c: F.when(F.col(f"{c}.s") == 0, F.lit(1.0)).otherwise(F.col(f"{c}.s"))
        return s.select(*[F.struct((F.col(f"{c}.m") - threshold * sd(c)).alias("lo"),
                                   (F.col(f"{c}.m") + threshold * sd(c)).alias("hi")).alias(c) for c in cols])
    if method == "percentile":
        q = _qrow(df, cols, [0.01, 0.99])
        return q.select(*[F.struct(F.col(f"{c}.q0").alias("lo"), F.col(f"{c}.q1").alias("hi")).alias(c) for c in cols])
    if method == "none":
        return df.sparkSession.range(1).select(*[F.struct(F.lit(None).cast("double").alias("lo"),
                                                          F.lit(None).cast("double").alias("hi")).alias(c) for c in cols])
    raise ValueError(method)


def apply_clip(df: DataFrame, bounds: DataFrame, cols: Sequence[str]) -> DataFrame:
    x = bind_stats(df, bounds, "_clip")
    def clip(c):
        v = F.col(c).cast("double")
        lo, hi = F.col(f"_clip.{c}.lo"), F.col(f"_clip.{c}.hi")
        return F.when(v.isNull(), v).otherwise(F.least(F.greatest(v, F.coalesce(lo, v)), F.coalesce(hi, v)))
    return x.withColumns({c: clip(c) for c in cols}).drop("_clip")


# ---------------------------------------------------------------- G07 / G08 / G16
def fit_scaler(df: DataFrame, cols: Sequence[str], method: str = "standard") -> DataFrame:
    """(center, scale) per column.  standard: mean / pop std (0 → 1);
    minmax: min / range (0 → 1); robust: median / IQR (0 → 1)."""
    if method == "standard":
        s = df.agg(*[F.struct(F.avg(c).alias("c"), F.stddev_pop(c).alias("s")).alias(c) for c in cols])
    elif method == "minmax":
        s = df.agg(*[F.struct(F.min(c).cast("double").alias("c"), (F.max(c) - F.min(c)).cast("double").alias("s")).alias(c)
                     for c in cols])
    elif method == "robust":
        q = _qrow(df, cols, [0.25, 0.5, 0.75])
        s = q.select(*[F.struct(F.col(f"{c}.q1").alias("c"), (F.col(f"{c}.q2") - F.col(f"{c}.q0")).alias("s")).alias(c)
                       for c in cols])
    else:
        raise ValueError(method)
    return s.select(*[F.struct(F.col(f"{c}.c").alias("c"),
                               F.when((F.col(f"{c}.s") == 0) | F.col(f"{c}.s").isNull(), F.lit(1.0))
                               .otherwise(F.col(f"{c}.s")).alias("s")).alias(c) for c in cols])


def apply_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    x = bind_stats(df, stats, "_sc")
    return x.withColumns({c: (F.col(c) - F.col(f"_sc.{c}.c")) / F.col(f"_sc.{c}.s") for c in cols}).drop("_sc")


def inverse_scaler(df: DataFrame, stats: DataFrame, cols: Sequence[str]) -> DataFrame:
    """x = z·scale + center."""
    x = bind_stats(df, stats, "_sc")
    return x.withColumns({c: F.col(c) * F.col(f"_sc.{c}.s") + F.col(f"_sc.{c}.c") for c in cols}).drop("_sc")


def normalize_rows(cols: Sequence[str]) -> list[Column]:
    """G07 normalizer: divide each row by its L2 norm (0 → unchanged)."""
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0)))
    return [F.when(n == 0, F.col(c)).otherwise(F.col(c) / n).alias(c) for c in cols]


def binarize(col: str, threshold: float = 0.0) -> Column:
    return (F.col(col) > threshold).cast("double").alias(col)


def auto_scale_method(df: DataFrame, cols: Sequence[str], z: float = 3.0) -> DataFrame:
    """Robust if any |z| (sample std) exceeds ``z`` else standard; a
    constant column has no z."""
    s = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in cols])
    x = bind_stats(df, s, "_a")
    mx = x.agg(F.greatest(*[F.max(F.abs(F.try_divide(F.col(c) - F.col(f"_a.{c}.m"), F.col(f"_a.{c}.s")))) for c in cols]
                          ).alias("max_abs_z") if len(cols) > 1 else
               F.max(F.abs(F.try_divide(F.col(cols[0]) - F.col(f"_a.{cols[0]}.m"),
                                        F.col(f"_a.{cols[0]}.s")))).alias("max_abs_z"))
    return mx.withColumn("method", F.when(F.col("max_abs_z") > z, "robust").otherwise("standard"))


# ---------------------------------------------------------------- G09
def _yj(x: Column, lam: float) -> Column:
    pos = x >= 0
    if abs(lam) < 1e-12:
        a = F.log1p(x)
    else:
        a = (F.pow(x + 1, F.lit(lam)) - 1) / lam
    if abs(lam - 2) < 1e-12:
        b = -F.log1p(-x)
    else:
        b = -(F.pow(-x + 1, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(pos, a).otherwise(b)


def fit_yeo_johnson(df: DataFrame, col: str, grid: Sequence[float] | None = None) -> float:
    """λ maximising the Yeo–Johnson log-likelihood over a grid, all
    candidate λ evaluated in one aggregate (grid search, not Brent: stated)."""
    grid = list(grid or np.round(np.arange(-2.0, 2.0001, 0.05), 4))
    x = F.col(col).cast("double")
    aggs = [F.count(x).alias("n"), F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("t")]
    for i, lam in enumerate(grid):
        y = _yj(x, float(lam))
        aggs += [F.var_pop(y).alias(f"v{i}")]
    row = df.agg(*aggs).first()
    best, best_ll = grid[0], -np.inf
    for i, lam in enumerate(grid):
        v = row[f"v{i}"]
        if v is None or v <= 0:
            continue
        ll = -row["n"] / 2 * np.log(v) + (lam - 1) * row["t"]
        if ll > best_ll:
            best, best_ll = lam, ll
    return float(best)


def apply_yeo_johnson(df: DataFrame, col: str, lam: float, standardize: bool = True) -> DataFrame:
    out = df.withColumn(col, _yj(F.col(col).cast("double"), lam))
    if standardize:
        out = apply_scaler(out, fit_scaler(out, [col]), [col])
    return out


def _norm_ppf_np(p: np.ndarray) -> np.ndarray:
    from ..functions.numeric import norm_ppf
    return np.vectorize(norm_ppf, otypes=[float])(p)


def fit_quantile_transform(df: DataFrame, col: str, n_quantiles: int = 1000) -> np.ndarray:
    """``n_quantiles`` exact reference quantiles (a bounded array)."""
    probs = np.linspace(0, 1, n_quantiles).tolist()
    q = quantiles(df, [col], probs).orderBy("p").collect()
    return np.array([r["q"] for r in q], dtype=float)


def apply_quantile_transform(df: DataFrame, col: str, refs: np.ndarray, output: str = "uniform") -> DataFrame:
    """Interpolate into the reference quantiles (Arrow-batched UDF with
    numpy.interp over the broadcast array); normal output via Φ⁻¹ clipped."""
    ref_b = df.sparkSession.sparkContext.broadcast(refs)
    probs = np.linspace(0, 1, len(refs))

    @F.pandas_udf("double")
    def _interp(s: pd.Series) -> pd.Series:
        r = ref_b.value
        u = 0.5 * (np.interp(s.to_numpy(dtype=float), r, probs) - np.interp(-s.to_numpy(dtype=float), -r[::-1], -probs[::-1]))
        if output == "normal":
            u = _norm_ppf_np(np.clip(u, 1e-7, 1 - 1e-7))
        return pd.Series(u)

    return df.withColumn(col, _interp(F.col(col).cast("double")))


# ---------------------------------------------------------------- G10 / G11
def polynomial2(cols: Sequence[str], bias: bool = True) -> list[Column]:
    """1, x_i, x_i·x_j (i ≤ j) in sklearn order."""
    out = [F.lit(1.0).alias("bias")] if bias else []
    out += [F.col(c).cast("double").alias(c) for c in cols]
    for i, a in enumerate(cols):
        for b in cols[i:]:
            out.append((F.col(a) * F.col(b)).cast("double").alias(f"{a}__x__{b}" if a != b else f"{a}__sq"))
    return out


def fit_kbins(df: DataFrame, cols: Sequence[str], n_bins: int = 5) -> DataFrame:
    """Quantile edges per column (exact), duplicates dropped later."""
    probs = [i / n_bins for i in range(n_bins + 1)]
    q = _qrow(df, cols, probs)
    return q.select(*[F.array(*[F.col(f"{c}.q{i}") for i in range(n_bins + 1)]).alias(c) for c in cols])


def apply_kbins(df: DataFrame, edges: DataFrame, cols: Sequence[str], one_hot: bool = False,
                n_bins: int = 5) -> DataFrame:
    """bin = number of distinct inner edges ≤ x (digitize); optional one-hot."""
    x = bind_stats(df, edges, "_kb")
    out = {}
    for c in cols:
        e = F.col(f"_kb.{c}")
        # drop edges closer than 1e-8 to their predecessor, then keep the inner ones
        dedup = F.filter(e, lambda v, i: (i == 0) | (v - F.element_at(e, F.greatest(i, F.lit(1))) > 1e-8))
        inner = F.slice(dedup, 2, F.size(dedup) - 2)
        b = F.size(F.filter(inner, lambda v: v <= F.col(c)))
        out[c] = F.when(F.col(c).isNull(), F.lit(None)).otherwise(b).cast("int")
    x = x.withColumns(out).drop("_kb")
    if one_hot:
        x = x.withColumns({f"{c}_bin{k}": (F.col(c) == k).cast("int") for c in cols for k in range(n_bins)})
    return x


# ---------------------------------------------------------------- G12
def target_encode_oof(df: DataFrame, cat: str, y: str, fold: str, smoothing: float = 10.0) -> DataFrame:
    """Out-of-fold smoothed mean: for a row in fold f the encoding uses
    only rows of other folds: (Σy_other + m·ȳ_other) / (n_other + m)."""
    per = df.groupBy(cat, fold).agg(F.sum(y).alias("__s"), F.count(F.lit(1)).alias("__n"))
    tot_c = per.groupBy(cat).agg(F.sum("__s").alias("__cs"), F.sum("__n").alias("__cn"))
    fold_tot = df.groupBy(fold).agg(F.sum(y).alias("__fs"), F.count(F.lit(1)).alias("__fn"))
    all_tot = df.agg(F.sum(y).alias("__as"), F.count(F.lit(1)).alias("__an"))
    enc = per.join(tot_c, cat).join(F.broadcast(fold_tot), fold)
    enc = bind_stats(enc, all_tot, "_t")
    prior = (F.col("_t.__as") - F.col("__fs")) / (F.col("_t.__an") - F.col("__fn"))
    enc = enc.select(cat, fold, ((F.col("__cs") - F.col("__s") + smoothing * prior)
                                 / (F.col("__cn") - F.col("__n") + smoothing)).alias(f"{cat}_te"))
    return df.join(enc, [cat, fold], "left")


# ---------------------------------------------------------------- G13
def fit_categories(df: DataFrame, col: str) -> list:
    """Sorted distinct categories, as many as the one-hot form has columns;
    ``ordinal_encode`` keeps them in a table instead."""
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())


def one_hot(col: str, cats: Sequence) -> list[Column]:
    """Unknown → all zeros."""
    import re
    return [(F.col(col) == F.lit(v)).cast("int").alias(f"{col}_" + re.sub(r"[^0-9A-Za-z]+", "_", str(v)).strip("_"))
            for v in cats]


def ordinal(col: str, cats: Sequence) -> Column:
    """Position in the sorted categories; unknown → −1."""
    m = F.create_map(*[x for i, v in enumerate(cats) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(m[F.col(col)], F.lit(-1)).alias(f"{col}_ord")


# ---------------------------------------------------------------- G14 / G15
# Settings by name, as users of the presets know them.
PRESETS = {
    "default": {"impute": "median", "clip": "iqr", "scale": "standard", "encode": "onehot"},
    "robust": {"impute": "median", "clip": "iqr", "scale": "robust", "encode": "onehot"},
    "normalized": {"impute": "knn", "clip": "clip", "scale": "quantile", "encode": "onehot"},
    "minimal": {"impute": "zero", "clip": "none", "scale": "none", "encode": "ordinal"},
    "tree_optimized": {"impute": "median", "clip": "none", "scale": "none", "encode": "ordinal"},
    "neural": {"impute": "knn", "clip": "clip", "scale": "quantile", "encode": "onehot"},
}


def preset(name: str, **overrides) -> dict:
    """A named setting, single parts replaced; unknown names fall back to ``default``."""
    return {**PRESETS.get(name, PRESETS["default"]), **overrides}


def smart_preprocess(df: DataFrame, types: Mapping[str, str], config: Mapping | None = None,
                     keep: Sequence[str] = ()) -> DataFrame:
    """Per-type chains — continuous: impute (mean, median, most_frequent, zero, or knn by
    the first of ``keep`` as row id) → clip (iqr, zscore, clip at the 1st and 99th
    percentile) → scale (standard, robust, minmax, power, quantile to a normal);
    integer_count: median impute; binary: mode impute; categorical: mode → one-hot or
    ordinal (sorted categories).  Other columns are dropped."""
    cfg = {**PRESETS["default"], **(config or {})}
    cont = [c for c, t in types.items() if t == "continuous"]
    cnt = [c for c, t in types.items() if t == "integer_count"]
    binr = [c for c, t in types.items() if t == "binary"]
    cat = [c for c, t in types.items() if t == "categorical"]
    out = df.select(*keep, *cont, *cnt, *binr, *cat)
    if cont:
        out = _impute_continuous(out, cont, cfg["impute"], keep)
        if cfg["clip"] in ("iqr", "zscore", "clip"):
            method = {"clip": "percentile"}.get(cfg["clip"], cfg["clip"])
            out = apply_clip(out, fit_clip(out, cont, method, 1.5 if method == "iqr" else 3.0), cont)
        if cfg["scale"] == "quantile":
            for c in cont:
                out = apply_quantile_transform(out, c, fit_quantile_transform(out, c), "normal")
        elif cfg["scale"] == "power":
            for c in cont:
                out = apply_yeo_johnson(out, c, fit_yeo_johnson(out, c))
        elif cfg["scale"] not in (None, "none"):
            out = apply_scaler(out, fit_scaler(out, cont, cfg["scale"]), cont)
    if cnt:
        out = apply_imputer(out, fit_imputer(out, cnt, "median"), cnt)
    for c in binr + cat:
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(most_frequent(out, c)).cast(out.schema[c].dataType)))
    for c in cat:
        if cfg["encode"] == "ordinal":
            out = ordinal_encode(out, out.select(c), c)
        else:
            out = out.select(*[x for x in out.columns if x != c], *one_hot(c, fit_categories(out, c)))
    return out


def _impute_continuous(df: DataFrame, cols: Sequence[str], method: str, keep: Sequence[str]) -> DataFrame:
    if method != "knn":
        strategy = {"zero": "constant"}.get(method, method)
        return apply_imputer(df, fit_imputer(df, cols, strategy), cols)
    if not keep:
        raise ValueError("knn imputation needs a row id: name it first in keep")
    out = df
    for c in columns_with_missing(df, cols):
        filled = knn_impute(df.select(keep[0], *cols), keep[0], c, [o for o in cols if o != c]).select(keep[0], F.col(c).alias("__f"))
        out = out.join(filled, keep[0]).withColumn(c, F.col("__f")).drop("__f")
    return out


def most_frequent(df: DataFrame, col: str):
    """The most frequent value (ties: the smallest); None without any."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n"))
    row = counts.agg(F.min_by(col, F.struct(-F.col("n"), F.col(col)))).first()
    return row[0]


def ordinal_encode(df: DataFrame, fitted: DataFrame, col: str) -> DataFrame:
    """``<col>_ord`` instead of ``col``: place among the sorted values of ``fitted``, −1 if
    not there or null; by a join, for any number of categories."""
    from ..functions.stats import global_rank
    values = fitted.select(F.col(col).alias("__c")).where(F.col("__c").isNotNull()).distinct()
    rank = global_rank(values, ["__c"]).select("__c", (F.col("__rn") - 1).cast("int").alias("__o"))
    return (df.join(rank, F.col(col) == F.col("__c"), "left").withColumn(f"{col}_ord", F.coalesce("__o", F.lit(-1)))
            .drop("__c", "__o", col))


# ---------------------------------------------------------------- G17 / G18
def add_feature_noise(df: DataFrame, cols: Sequence[str], level: float = 0.01, seed: int = 42, key: Column | None = None) -> DataFrame:
    """X + N(0, level·std_pop(x)) on float columns.  The normal numbers come from
    hashes of ``key`` (the whole row without one), so that they do not depend on the
    partitioning; rows of one key share them."""
    k = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns]) if key is None else key
    s = df.agg(*[F.stddev_pop(c).alias(c) for c in cols])
    x = bind_stats(df.withColumn("__k", k), s, "_n")
    noise = {c: F.sqrt(-2 * F.log((hash_u32(f"{seed}:{i}:r", F.col("__k")) + 1) / F.lit(4294967296.0)))
             * F.cos(2 * math.pi * hash_unit(f"{seed}:{i}:a", F.col("__k"))) for i, c in enumerate(cols)}
    return x.withColumns({c: F.col(c) + n * F.col(f"_n.{c}") * level for c, n in noise.items()}).drop("_n", "__k")


def augment_rows(df: DataFrame, n: int, variant: Column) -> DataFrame:
    """N variants per row (variant expression sees ``augment_id``)."""
    return df.withColumn("augment_id", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("variant", variant)


def mean_shift(source: DataFrame, target: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Source − mean(source) + mean(target) per column."""
    ms = source.agg(*[F.avg(c).alias(c) for c in cols])
    mt = target.agg(*[F.avg(c).alias(c) for c in cols])
    x = bind_stats(bind_stats(source, ms, "_s"), mt, "_t")
    return x.withColumns({c: F.col(c) - F.col(f"_s.{c}") + F.col(f"_t.{c}") for c in cols}).drop("_s", "_t")


# ---------------------------------------------------------------- G03
def knn_impute(df: DataFrame, id_col: str, target: str, feature_cols: Sequence[str], k: int = 5) -> DataFrame:
    """A missing ``target`` becomes the mean of the k nearest donors
    (rows where it is present), nearest by euclidean distance over the
    features that both rows have, scaled up to all features; ties: smaller
    id.  Exact: every donor counts.  A row that has no feature in common with any
    donor gets the donors' mean."""
    from .neighbors import dense_topk
    vec = F.array(*[F.col(c).cast("double") for c in feature_cols])
    miss = df.where(F.col(target).isNull()).select(id_col, vec.alias("v"))
    donors = df.where(F.col(target).isNotNull()).select(id_col, vec.alias("v"))
    nn = dense_topk(miss, donors, id_col, id_col, "v", k, "euclidean")
    vals = df.select(F.col(id_col).alias("did"), F.col(target).cast("double").alias("dv"))
    fill = nn.join(vals, "did").groupBy(F.col("qid").alias(id_col)).agg(F.avg("dv").alias("__fill"))
    mean = df.agg(F.avg(target)).first()[0]
    return df.join(fill, id_col, "left").withColumn(
        target, F.coalesce(F.col(target).cast("double"), F.col("__fill"), F.lit(mean).cast("double"))).drop("__fill")


# ---------------------------------------------------------------- G04
def iterative_impute(df: DataFrame, cols: Sequence[str], max_iter: int = 10, tol: float = 1e-3) -> DataFrame:
    """Start from column means, then round-robin over the columns with missing
    values, those with fewest first: each is predicted by a Bayesian ridge on
    all other columns, fitted on its observed rows (cross products in one pass,
    evidence maximised on the driver).  Stops after ``max_iter`` rounds or when no
    value moves by more than ``tol`` times the greatest observed magnitude.  Lineage is
    cut every round.  A column without any value stays as it is and is not used."""
    from ..functions.linear import bayesian_ridge, gram
    from ..session import cut_lineage
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)], *[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.max(F.abs(F.col(c).cast("double"))).alias(f"a{i}") for i, c in enumerate(cols)]).first()
    used = [(i, c) for i, c in enumerate(cols) if row[f"m{i}"] is not None]
    miss = [c for i, c in sorted(used, key=lambda t: (row[f"n{t[0]}"], t[0])) if row[f"n{i}"]]
    names = [c for _, c in used]
    if not miss or len(names) < 2:
        return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(row[f"m{i}"])) for i, c in used if c in miss})
    least = tol * max(row[f"a{i}"] for i, _ in used)
    cur = df.withColumns({f"__m_{c}": F.col(c).isNull() for c in miss})
    cur = cut_lineage(cur.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(float(row[f"m{i}"]))) for i, c in used if c in miss}))
    for _ in range(max_iter):
        cur = cur.withColumns({f"__p_{c}": F.col(c) for c in miss})
        for c in miss:
            others = [o for o in names if o != c]
            coef, intercept = bayesian_ridge(*gram(cur.where(~F.col(f"__m_{c}")), [*others, c]))
            value = F.lit(intercept)
            for o, b in zip(others, coef):
                value = value + F.col(o) * F.lit(float(b))
            cur = cur.withColumn(c, F.when(F.col(f"__m_{c}"), value).otherwise(F.col(c)))
        cur = cut_lineage(cur)
        moved = cur.agg(*[F.max(F.abs(F.col(c) - F.col(f"__p_{c}"))).alias(c) for c in miss]).first()
        cur = cur.drop(*[f"__p_{c}" for c in miss])
        if max(moved) < least:
            break
    return cur.drop(*[f"__m_{c}" for c in miss])
