"""Feature selection.

Every score is one Spark aggregate over the data (variances, Pearson
correlations, binned joint counts, class moments, the Gram matrix); only
the p-sized results (one row, or p×p) reach the driver, where greedy
loops (VIF, mRMR, wrappers) run over them.  Model-based selectors fit
``pyspark.ml`` estimators on one cached feature vector.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_unit, safe_corr
from ..functions.numeric import binom_sf_ge, chi2_sf, f_sf
from ..functions.stats import quantile_row
from ..operators.quality import correlation_long


def _long(one: DataFrame, cols: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """Stack a one-row frame with per-column fields into (feature, …)."""
    arr = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"),
                             *[F.col(f"{c}__{k}").alias(k) for k in fields]) for i, c in enumerate(cols)])
    return one.select(F.inline(arr))


# ---------------------------------------------------------------- I01
def variance_scores(df: DataFrame, cols: Sequence[str], threshold: float = 0.0,
                    sample: bool = False) -> DataFrame:
    """(feature, variance, kept) with kept = variance > threshold
    (population variance, or sample variance when ``sample``)."""
    var = F.var_samp if sample else F.var_pop
    one = df.agg(*[var(F.col(c).cast("double")).alias(f"{c}__variance") for c in cols])
    out = _long(one, cols, {"variance": "double"})
    return out.withColumn("kept", F.col("variance") > F.lit(threshold)).drop("pos")


# ---------------------------------------------------------------- I02
def median_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    med = quantile_row(df, cols, [0.5]).first()
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(med[f"{c}__q0"])) for c in cols})


def correlation_drop(df: DataFrame, cols: Sequence[str], threshold: float = 0.95,
                     fill: bool = True) -> DataFrame:
    """A column is dropped when |corr| > threshold with any EARLIER
    column — decided on the full matrix (an earlier column counts even if
    it is itself dropped).  Median fill first."""
    data = median_fill(df, cols) if fill else df
    cl = correlation_long(data, cols)
    pos = {c: i for i, c in enumerate(cols)}
    # correlation_long is the upper triangle in column order: col_b is the later column
    worst = cl.groupBy(F.col("col_b").alias("feature")).agg(F.max(F.abs("corr")).alias("max_abs_corr_earlier"))
    feats = df.sparkSession.createDataFrame([(c, i) for c, i in pos.items()], "feature string, pos int")
    out = feats.join(worst, "feature", "left")
    return out.select("feature", "pos", "max_abs_corr_earlier",
                      F.coalesce(F.col("max_abs_corr_earlier") > F.lit(threshold), F.lit(False)).alias("dropped"))


# ---------------------------------------------------------------- I03
def clean_features_plan(df: DataFrame, cols: Sequence[str], max_missing: float = 0.5) -> DataFrame:
    """I03 decisions: (feature, missing_ratio, n_distinct, median, kept):
    kept when missing ≤ 50 % and more than one distinct value."""
    one = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[F.sum(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0)).alias(f"{c}__miss")
                   for c in cols],
                 *[F.count_distinct(F.col(c)).alias(f"{c}__n_distinct") for c in cols])
    med = quantile_row(df.select([F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c)
                                  for c in cols]), cols, [0.5])
    one = one.withColumns({f"{c}__median": med.select(f"{c}__q0").scalar() for c in cols})
    out = _long(one.withColumns({f"{c}__missing_ratio": F.col(f"{c}__miss") / F.col("__n") for c in cols}),
                cols, {"missing_ratio": "double", "n_distinct": "long", "median": "double"})
    return out.withColumn("kept", (F.col("missing_ratio") <= max_missing) & (F.col("n_distinct") > 1)).drop("pos")


def clean_features(df: DataFrame, cols: Sequence[str], keep_cols: Sequence[str] = (),
                   max_missing: float = 0.5) -> DataFrame:
    """Kept numeric columns, median-filled."""
    plan = clean_features_plan(df, cols, max_missing).where("kept").collect()  # p rows
    kept = [(r["feature"], r["median"]) for r in plan]
    return df.select(*keep_cols, *[F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")),
                                              F.lit(m)).alias(c) for c, m in kept])


# ---------------------------------------------------------------- I04
def target_correlation(df: DataFrame, cols: Sequence[str], y: str, min_score: float = 0.05,
                       k: int | None = None) -> DataFrame:
    """score = |Pearson(x, y)| (NaN/undefined → 0); selected when
    score ≥ min_score and within the best k (ties by column order)."""
    one = df.agg(*[safe_corr(F.col(c), F.col(y)).alias(f"{c}__r") for c in cols])
    out = _long(one, cols, {"r": "double"})
    out = out.withColumn("score", F.coalesce(F.abs(F.nanvl("r", F.lit(None).cast("double"))), F.lit(0.0)))
    rk = F.row_number().over(_rank_window())
    out = out.withColumn("rank", rk)
    sel = F.col("score") >= min_score
    if k is not None:
        sel = sel & (F.col("rank") <= k)
    return out.withColumn("selected", sel).select("feature", "score", "rank", "selected")


def _rank_window():
    from pyspark.sql import Window
    # p rows only (one per feature): a global window over the score table is fine
    return Window.orderBy(F.round("score", 9).desc(), F.col("pos"))


# ---------------------------------------------------------------- I05
def mutual_info(df: DataFrame, cols: Sequence[str], y: str, bins: int = 10,
                y_discrete: bool = False, normalize: bool = True) -> DataFrame:
    """Binned mutual information Σ p(x,y)·ln(p(x,y)/(p(x)p(y))) with
    equal-width bins on [min, max] (the top edge joins the last bin); y is
    binned the same way unless discrete.  Max-normalised.  The estimator
    without bins is ``nearest_mutual_info``."""
    ycol = F.col(y)
    allc = list(cols) + ([] if y_discrete else [y])
    mm = df.agg(*[F.min(F.col(c).cast("double")).alias(f"{c}__min") for c in allc],
                *[F.max(F.col(c).cast("double")).alias(f"{c}__max") for c in allc]).first()

    def binned(c):
        lo, hi = mm[f"{c}__min"], mm[f"{c}__max"]
        if lo is None or hi is None or hi == lo:
            return F.lit(0)
        b = F.floor((F.col(c).cast("double") - F.lit(lo)) / F.lit((hi - lo) / bins)).cast("int")
        # least() skips nulls: keep a missing value missing
        return F.when(F.col(c).isNotNull(), F.least(b, F.lit(bins - 1)))
    yb = ycol.cast("string") if y_discrete else binned(y).cast("string")
    stacked = df.where(ycol.isNotNull()).select(yb.alias("yb"), F.explode(F.array(
        *[F.struct(F.lit(c).alias("feature"), binned(c).alias("xb")) for c in cols])).alias("s")).where(
        F.col("s.xb").isNotNull()).select("s.feature", "s.xb", "yb")
    joint = stacked.groupBy("feature", "xb", "yb").agg(F.count(F.lit(1)).alias("nxy"))
    nx = joint.groupBy("feature", "xb").agg(F.sum("nxy").alias("nx"))
    ny = joint.groupBy("feature", "yb").agg(F.sum("nxy").alias("ny"))
    n = joint.groupBy("feature").agg(F.sum("nxy").alias("n"))
    j = joint.join(nx, ["feature", "xb"]).join(ny, ["feature", "yb"]).join(n, "feature")
    term = (F.col("nxy") / F.col("n")) * F.log((F.col("nxy") * F.col("n")) / (F.col("nx") * F.col("ny")))
    mi = j.groupBy("feature").agg(F.sum(term).alias("mi"))
    feats = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(cols)], "feature string, pos int")
    out = feats.join(mi, "feature", "left").withColumn("mi", F.coalesce("mi", F.lit(0.0)))
    if normalize:
        mx = out.agg(F.max("mi")).first()[0]
        out = out.withColumn("score", F.col("mi") / F.lit(mx) if mx and mx > 0 else F.lit(0.0))
    else:
        out = out.withColumn("score", F.col("mi"))
    return out.select("feature", "pos", "mi", "score")


#: Units a standard deviation is cut into, so that equal distances are equal.
_UNITS = 1_000_000


def digamma(n):
    """ψ of a column of counts ≥ 1."""
    small = [0.0]
    for k in range(1, 11):
        small.append(-0.5772156649015329 + sum(1.0 / i for i in range(1, k)))
    x = n.cast("double")
    large = F.log(x) - 1 / (2 * x) - 1 / (12 * x ** 2) + 1 / (120 * x ** 4) - 1 / (252 * x ** 6) + 1 / (240 * x ** 8)
    return F.when(n <= 10, F.element_at(F.array(*[F.lit(v) for v in small]), F.least(n, F.lit(10)).cast("int") + 1)).otherwise(large)


def within(values: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, n): how many ``values`` (x) are in lo … hi of each row (id, lo, hi), by one
    running sum over the values and the ends of the intervals in order."""
    from ..functions.stats import global_rank
    ends = rows.select("id", F.inline(F.array(F.struct(F.col("lo").alias("x"), F.lit(0).alias("place"), F.lit(-1).alias("sign")),
                                              F.struct(F.col("hi").alias("x"), F.lit(2).alias("place"), F.lit(1).alias("sign")))))
    # Equal values come after a lower end and before an upper end; counted values go as one row.
    held = values.groupBy("x").agg(F.count("*").alias("w")).select(
        F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "x", F.lit(1).alias("place"), F.lit(0).alias("sign"), "w")
    r = global_rank(held.unionByName(ends.withColumn("w", F.lit(0).cast("bigint"))), ["x", "place", "id"], weight_col="w")
    return r.where("sign <> 0").groupBy("id").agg(F.sum(F.col("sign") * F.col("__cum")).cast("bigint").alias("n"))


def nearest_mutual_info(df: DataFrame, key: str, cols: Sequence[str], y: str, k: int = 3, y_discrete: bool = False) -> DataFrame:
    """Mutual information of each column with ``y`` from nearest neighbours.

    For a numeric y: with r the distance (greater of both axes) of a row's k-th
    neighbour, ψ(n) + ψ(k) − mean ψ(rows nearer than r in x) − mean ψ(the same in y), the row
    itself counted.  For a discrete y: r is the distance in x of the k-th neighbour of the same
    label, and ψ(n) + mean ψ(k) − mean ψ(rows of the label) − mean ψ(rows nearer than
    r in x); labels of one row are left out.  At r = 0 rows at distance 0 count.  At
    least 0.  Values are taken to a millionth of their standard deviation, without
    noise; rows with a null are left out per column; ``key`` must differ between rows."""
    from ..session import cut_lineage
    from .neighbors import dense_topk

    def units(c, sd):
        return F.round(F.col(c).cast("double") / F.lit(sd) * _UNITS)

    rows = []
    for pos, c in enumerate(cols):
        x = df.select(F.col(key).alias("id"), F.col(c).cast("double").alias("x"), F.col(y).alias("y")).na.drop()
        sd = x.agg(F.stddev_pop("x").alias("x"), *([] if y_discrete else [F.stddev_pop("y").alias("y")])).first()
        x = x.withColumn("x", units("x", sd["x"] or 1.0))
        if y_discrete:
            # Labels are set apart by more than any distance in x.
            far = x.agg((F.max("x") - F.min("x") + 1) * 2).first()[0] or 1.0
            labels = x.groupBy("y").agg(F.count("*").alias("of")).where("of > 1")
            index = labels.select("y", "of", F.pmod(F.xxhash64("y"), F.lit(1 << 31)).alias("h"))
            x = cut_lineage(x.join(index, "y").withColumn("k", F.least(F.lit(k), F.col("of") - 1))
                            .withColumn("v", F.array("x", F.col("h") * F.lit(far))))
        else:
            x = cut_lineage(x.withColumn("y", units("y", sd["y"] or 1.0)).withColumn("k", F.lit(k)).withColumn("v", F.array("x", "y")))
        n = x.count()
        if n <= k:
            rows.append((c, pos, 0.0))
            continue
        near = dense_topk(x, x, "id", "id", "v", k, "chebyshev", exclude_self=True)
        r = x.join(near.withColumnRenamed("qid", "id"), "id").where(F.col("rank") == F.col("k"))
        # Whole units: nearer than r is at most r − 1, or 0.
        r = cut_lineage(r.select("id", "x", "y", "k", *(["of"] if y_discrete else []), F.greatest(F.col("score") - 1, F.lit(0.0)).alias("r")))
        axes = ["x"] if y_discrete else ["x", "y"]
        parts = [within(x.select(F.col(a).alias("x")), r.select("id", (F.col(a) - F.col("r")).alias("lo"), (F.col(a) + F.col("r")).alias("hi")))
                 .agg(F.avg(digamma(F.col("n")))).first()[0] for a in axes]
        m = r.agg(F.avg(digamma(F.col("k"))).alias("k"), *([F.avg(digamma(F.col("of"))).alias("of")] if y_discrete else [])).first()
        psi = df.sparkSession.range(1).select(digamma(F.lit(n))).first()[0]
        rows.append((c, pos, max(0.0, psi + m["k"] - (m["of"] if y_discrete else 0.0) - sum(parts))))
    return df.sparkSession.createDataFrame(rows, "feature string, pos int, mi double")


# ---------------------------------------------------------------- I06
def f_regression(df: DataFrame, cols: Sequence[str], y: str) -> DataFrame:
    """I06 regression F: F = r²/(1−r²)·(n−2) from one corr aggregate."""
    one = df.agg(F.count(F.lit(1)).alias("__n"),
                 *[safe_corr(F.col(c), F.col(y)).alias(f"{c}__r") for c in cols])
    out = _long(one.withColumns({f"{c}__n": F.col("__n") for c in cols}), cols, {"r": "double", "n": "long"})
    r2 = F.col("r") * F.col("r")
    return out.select("feature", "pos", "n", (r2 / (F.lit(1.0) - r2) * (F.col("n") - 2)).alias("score"),
                      F.lit(1.0).alias("df1"), (F.col("n") - 2).cast("double").alias("df2"))


def f_classif(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """I06 ANOVA F: between / within mean squares from per-class moments."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("nk"),
                              *[F.sum(F.col(c).cast("double")).alias(f"{c}__s") for c in cols],
                              *[F.sum(F.col(c).cast("double") ** 2).alias(f"{c}__ss") for c in cols])
    exprs = [F.sum("nk").alias("__n"), F.count(F.lit(1)).alias("__k")]
    for c in cols:
        exprs += [F.sum(f"{c}__s").alias(f"{c}__S"), F.sum(f"{c}__ss").alias(f"{c}__SS"),
                  F.sum(F.col(f"{c}__s") ** 2 / F.col("nk")).alias(f"{c}__B")]
    one = g.agg(*exprs)
    outs = {}
    for c in cols:
        ssb = F.col(f"{c}__B") - F.col(f"{c}__S") ** 2 / F.col("__n")
        ssw = F.col(f"{c}__SS") - F.col(f"{c}__B")
        outs[f"{c}__score"] = F.try_divide(F.try_divide(ssb, F.col("__k") - 1),
                                          F.try_divide(ssw, F.col("__n") - F.col("__k")))
        outs[f"{c}__df1"] = (F.col("__k") - 1).cast("double")
        outs[f"{c}__df2"] = (F.col("__n") - F.col("__k")).cast("double")
        outs[f"{c}__n"] = F.col("__n")
    out = _long(one.withColumns(outs), cols, {"n": "long", "score": "double", "df1": "double", "df2": "double"})
    return out.select("feature", "pos", "n", "score", "df1", "df2")


def chi2_classif(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """I06 chi²: observed = Σx per class, expected = class share × Σx."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("nk"), *[F.sum(F.col(c).cast("double")).alias(c) for c in cols])
    tot = g.agg(F.sum("nk").alias("__n"), F.count(F.lit(1)).alias("__k"),
                *[F.sum(c).alias(f"{c}__T") for c in cols])
    trow = tot.first()
    exprs = []
    for c in cols:
        e = F.col("nk") / F.lit(trow["__n"]) * F.lit(trow[f"{c}__T"])
        exprs.append(F.sum(F.try_divide((F.col(c) - e) ** 2, e)).alias(f"{c}__score"))
    one = g.agg(*exprs).withColumns({**{f"{c}__df1": F.lit(float(trow["__k"] - 1)) for c in cols},
                                     **{f"{c}__df2": F.lit(None).cast("double") for c in cols},
                                     **{f"{c}__n": F.lit(trow["__n"]).cast("long") for c in cols}})
    out = _long(one, cols, {"n": "long", "score": "double", "df1": "double", "df2": "double"})
    return out.select("feature", "pos", "n", "score", "df1", "df2")


def univariate_select(scores: DataFrame, mode: str = "k_best", param: float = 10,
                      test: str = "f") -> DataFrame:
    """I06 selection on a p-row score table: k_best, percentile, fpr, fdr
    (Benjamini–Hochberg), fwe (Bonferroni).  p-values on the driver from the
    p-row result (no SciPy: incomplete beta / gamma)."""
    rows = scores.orderBy("pos").collect()
    p = len(rows)
    out = []
    for r in rows:
        s = r["score"]
        if s is None or (isinstance(s, float) and math.isnan(s)):
            pv = 1.0
        elif test == "chi2":
            pv = chi2_sf(s, r["df1"])
        else:
            pv = f_sf(s, r["df1"], r["df2"]) if math.isfinite(s) else 0.0
        out.append((r["feature"], r["pos"], float(s) if s is not None else None, pv))
    order = sorted(range(p), key=lambda i: (-(out[i][2] if out[i][2] is not None and not math.isnan(out[i][2]) else -math.inf), out[i][1]))
    sel = [False] * p
    if mode == "k_best":
        for i in order[:int(param)]:
            sel[i] = True
    elif mode == "percentile":
        for i in order[:int(math.floor(p * param / 100))]:
            sel[i] = True
    elif mode == "fpr":
        sel = [o[3] < param for o in out]
    elif mode == "fwe":
        sel = [o[3] < param / p for o in out]
    elif mode == "fdr":
        ps = sorted(o[3] for o in out)
        cut = max([ps[i] for i in range(p) if ps[i] <= param * (i + 1) / p], default=-1.0)
        sel = [o[3] <= cut for o in out]
    else:
        raise ValueError(mode)
    spark = scores.sparkSession
    return spark.createDataFrame([(o[0], o[2], o[3], s) for o, s in zip(out, sel)],
                                 "feature string, score double, p_value double, selected boolean")


# ---------------------------------------------------------------- I07
def gram(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """XᵀX in one aggregate (p(p+1)/2 sums)."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*[F.sum(F.col(cols[i]).cast("double") * F.col(cols[j]).cast("double")).alias(f"g{i}_{j}")
                   for i, j in pairs]).first()
    g = np.zeros((len(cols), len(cols)))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"]
    return g


def vif_elimination(df: DataFrame, cols: Sequence[str], threshold: float = 10.0) -> DataFrame:
    """Repeatedly drop the column with the largest VIF above threshold.
    Uncentred, no intercept (statsmodels' definition): VIF_i = G_ii·(G⁻¹)_ii
    for the Gram matrix G — one Spark pass, then p×p algebra."""
    g = gram(df.na.drop(subset=list(cols)), cols)
    keep = list(range(len(cols)))
    steps = []
    step = 0
    while len(keep) > 1:
        sub = g[np.ix_(keep, keep)]
        inv = np.linalg.pinv(sub)
        vif = np.diag(sub) * np.diag(inv)
        worst = int(np.argmax(vif))
        if not vif[worst] > threshold:
            break
        step += 1
        steps.append((step, cols[keep[worst]], float(vif[worst])))
        keep.pop(worst)
    sub = g[np.ix_(keep, keep)]
    final = np.diag(sub) * np.diag(np.linalg.pinv(sub)) if len(keep) > 1 else np.ones(1)
    rows = [(s, f, v, False) for s, f, v in steps] + [(None, cols[k], float(v), True) for k, v in zip(keep, final)]
    return df.sparkSession.createDataFrame(rows, "step int, feature string, vif double, kept boolean")


# ---------------------------------------------------------------- I08
def mrmr(df: DataFrame, cols: Sequence[str], y: str, k: int = 5, bins: int = 10) -> DataFrame:
    """Greedy max relevance (binned MI with y) minus mean |corr| with the
    already selected; the MI vector and the correlation matrix come from two
    Spark aggregates, the greedy loop runs over the p×p result."""
    rel = {r["feature"]: r["mi"] for r in mutual_info(df, cols, y, bins, normalize=False).collect()}
    corr = {(r["col_a"], r["col_b"]): abs(r["corr"] or 0.0) for r in correlation_long(df, cols).collect()}

    def c(a, b):
        return corr.get((a, b), corr.get((b, a), 0.0))
    chosen: list[tuple[int, str, float]] = []
    left = list(cols)
    while left and len(chosen) < k:
        best = None
        for f in left:
            red = np.mean([c(f, s) for _, s, _ in chosen]) if chosen else 0.0
            sc = rel[f] - red
            if best is None or sc > best[1]:
                best = (f, sc)
        chosen.append((len(chosen) + 1, best[0], float(best[1])))
        left.remove(best[0])
    return df.sparkSession.createDataFrame(chosen, "step int, feature string, score double")


# ---------------------------------------------------------------- shared ML helpers
def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


#: Rounds of the bijection that permutes ranks, and fixed odd multipliers of its mixing.
_ROUNDS, _MIX = 6, (0x9E3779B1, 0x85EBCA77)


def round_keys(seed, column: int) -> list[int]:
    """Keys of the rounds for a seed and a column: 32 bits of an MD5 each."""
    import hashlib
    return [int(hashlib.md5(f"{seed}:{column}:{r}".encode()).hexdigest()[:8], 16) for r in range(_ROUNDS)]


def permuted_ranks(rank: np.ndarray, n: int, keys: Sequence[int]) -> np.ndarray:
    """A keyed bijection of 0 … n − 1: a Feistel network on the least even number of
    bits that holds n; ranks that leave the range walk on until they are back."""
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    low, out = np.uint64((1 << half) - 1), rank.astype(np.uint64)
    todo = np.arange(len(out))
    full = np.uint64(0xFFFFFFFF)
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            t = ((right + np.uint64(k)) & full) * np.uint64(_MIX[0]) & full
            t = (t ^ (t >> np.uint64(15))) * np.uint64(_MIX[1]) & full
            left, right = right, left ^ ((t >> np.uint64(7)) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def ranked(df: DataFrame, key: str) -> DataFrame:
    """The rows with their places ``__rank`` by ``key`` (from 0) and their number ``__n``, written
    once.  The key must differ between rows."""
    from ..functions.stats import global_rank
    from ..session import cut_lineage, release
    x = cut_lineage(global_rank(df, [key]).withColumn("__rank", F.col("__rn") - 1).drop("__rn", "__cum", "__wt"))
    release(df.sparkSession)
    return x


def moved_columns(x: DataFrame, cols: Sequence[str], seed, prefix: str) -> DataFrame:
    """(__rank, …) of ``ranked`` rows: permutations of the whole columns.  A keyed bijection of the
    ranks tells for each column where a row's value goes."""
    row = x.select("__n").first()
    keys = [round_keys(seed, i) for i in range(len(cols))]
    n = 0 if row is None else int(row[0])
    kinds = [x.schema[c].dataType.simpleString() for c in cols]

    def run(it):
        import pyarrow as pa
        for b in it:
            rank = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(len(cols)):
                moved = [b.column(1 + j) if j == i else pa.nulls(b.num_rows, b.schema.field(1 + j).type) for j in range(len(cols))]
                yield pa.RecordBatch.from_arrays([pa.array(permuted_ranks(rank, n, keys[i])), *moved],
                                                 ["__rank", *[f"__v{j}" for j in range(len(cols))]])

    long = x.select("__rank", *cols).mapInArrow(run, "__rank bigint, " + ", ".join(f"__v{j} {k}" for j, k in enumerate(kinds)))
    # One value a rank and column; the others are null.
    return long.groupBy("__rank").agg(*[F.max(f"__v{j}").alias(f"{prefix}{c}") for j, c in enumerate(cols)])


def permute_columns(df: DataFrame, key: str, cols: Sequence[str], seed, prefix: str = "shadow_") -> DataFrame:
    """Shadow copies of ``cols``, each a permutation of the whole column: rows are
    ranked by ``key`` once over the table, and one join by rank brings the values there.
    The key must differ between rows."""
    x = ranked(df, key)
    return x.join(moved_columns(x, cols, seed, prefix), "__rank").drop("__rank", "__n")


def permuted(df: DataFrame, key: str, col: str, seed, out: str | None = None) -> DataFrame:
    """One permuted column (replacing ``col`` unless ``out`` is given)."""
    x = permute_columns(df, key, [col], seed, prefix="__perm_")
    if out is None or out == col:
        return x.drop(col).withColumnRenamed(f"__perm_{col}", col)
    return x.withColumnRenamed(f"__perm_{col}", out)


def rf_importances(df: DataFrame, cols: Sequence[str], y: str, task: str = "regression", seed: int = 42,
                   num_trees: int = 20, max_depth: int = 5) -> dict[str, float]:
    """RandomForest ``featureImportances`` (impurity based)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.regression import RandomForestRegressor
    data = assemble(df, cols)
    est = (RandomForestRegressor if task == "regression" else RandomForestClassifier)(
        featuresCol="features", labelCol=y, numTrees=num_trees, maxDepth=max_depth, seed=seed)
    m = est.fit(data)
    imp = m.featureImportances.toArray()
    return {c: float(v) for c, v in zip(cols, imp)}


def boruta(df: DataFrame, key: str, cols: Sequence[str], y: str, n_iter: int = 5, alpha: float = 0.05,
           task: str = "regression", seed: int = 42) -> DataFrame:
    """Each iteration adds one permuted shadow per feature, fits a
    forest and scores a hit when a feature beats the best shadow; a feature
    is confirmed when hits are improbable under p=½ (exact binomial tail)."""
    hits = {c: 0 for c in cols}
    from ..session import release
    x = ranked(df.select(key, y, *cols), key).drop(key)
    for it in range(n_iter):
        data = x.join(moved_columns(x, cols, seed + 1000 * it, "shadow_"), "__rank").drop("__rank", "__n").cache()
        imp = rf_importances(data, list(cols) + [f"shadow_{c}" for c in cols], y, task, seed + it)
        data.unpersist()
        del data
        release(df.sparkSession)
        best_shadow = max(imp[f"shadow_{c}"] for c in cols)
        for c in cols:
            hits[c] += int(imp[c] > best_shadow)
    rows = []
    for c in cols:
        p = binom_sf_ge(hits[c], n_iter, 0.5)
        rows.append((c, hits[c], float(p), p < alpha))
    return df.sparkSession.createDataFrame(rows, "feature string, hits int, p_value double, confirmed boolean")


def _fit_linear(data: DataFrame, y: str):
    from pyspark.ml.regression import LinearRegression
    return LinearRegression(featuresCol="features", labelCol=y, solver="normal").fit(data)


def _r2(model, data: DataFrame, y: str) -> float:
    from pyspark.ml.evaluation import RegressionEvaluator
    return RegressionEvaluator(labelCol=y, predictionCol="prediction", metricName="r2").evaluate(model.transform(data))


def permutation_importance(df: DataFrame, key: str, cols: Sequence[str], y: str, n_repeats: int = 3,
                           seed: int = 42, k: int | None = None) -> DataFrame:
    """Mean drop of R² on the data when one column is permuted (model
    fitted once: linear regression on the assembled vector).  Rows are ranked once; a
    permutation moves one column, and meets what the model leaves of y without that column."""
    from ..session import release
    base = df.select(key, y, *cols).na.drop()
    data = assemble(base, cols)
    model = _fit_linear(data, y)
    ref = _r2(model, data, y)
    x = ranked(base, key).drop(key)
    total = x.agg(F.var_pop(y) * F.count("*")).first()[0]
    coef = [float(v) for v in model.coefficients]
    rows = []
    for i, c in enumerate(cols):
        drops = []
        left = F.col(y) - F.lit(float(model.intercept))
        for j, v in enumerate(cols):
            if j != i:
                left = left - F.col(v) * F.lit(coef[j])
        own = x.select("__rank", left.alias("__left"))
        for r in range(n_repeats):
            both = own.join(moved_columns(x, [c], seed + 31 * r + i, "__perm_"), "__rank")
            off = F.col("__left") - F.col(f"__perm_{c}") * F.lit(coef[i])
            error = both.agg(F.sum(off * off)).first()[0]
            drops.append(ref - float(1 - np.float64(error) / np.float64(total)))
            del both
            release(df.sparkSession)
        rows.append((c, float(np.mean(drops)), float(np.std(drops))))
    rows.sort(key=lambda t: -t[1])
    rows = [(f, m, s, i + 1, k is None or i < k) for i, (f, m, s) in enumerate(rows)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double, std double, rank int, selected boolean")


def combined_scores(df: DataFrame, cols: Sequence[str], y: str, seed: int = 42) -> DataFrame:
    """Correlation, MI and forest importance, each max-normalised, and
    their mean."""
    corr = {r["feature"]: r["score"] for r in target_correlation(df, cols, y).collect()}
    mi = {r["feature"]: r["score"] for r in mutual_info(df, cols, y).collect()}
    imp = rf_importances(df.na.drop(subset=list(cols) + [y]), cols, y, seed=seed)

    def norm(d):
        m = max(d.values()) if d else 0.0
        return {k: (v / m if m > 0 else 0.0) for k, v in d.items()}
    nc, nm, ni = norm(corr), norm(mi), norm(imp)
    rows = [(c, nc[c], nm[c], ni[c], float((nc[c] + nm[c] + ni[c]) / 3)) for c in cols]
    return df.sparkSession.createDataFrame(
        rows, "feature string, correlation double, mutual_info double, importance double, combined double")


# ---------------------------------------------------------------- I12
def vote(selections: Sequence[DataFrame], threshold: float = 0.5, k: int | None = None) -> DataFrame:
    """Each selection is a frame of selected ``feature`` names; a
    feature is chosen with votes ≥ threshold · methods, by votes desc (ties
    by name), top k."""
    from pyspark.sql import Window
    u = selections[0].select("feature")
    for s in selections[1:]:
        u = u.unionByName(s.select("feature"))
    votes = u.groupBy("feature").agg(F.count(F.lit(1)).alias("votes"))
    need = threshold * len(selections)
    out = votes.where(F.col("votes") >= F.lit(need))
    w = Window.orderBy(F.col("votes").desc(), F.col("feature"))  # ≤ p rows
    out = out.withColumn("rank", F.row_number().over(w))
    if k is not None:
        out = out.where(F.col("rank") <= k)
    return out


# ---------------------------------------------------------------- I13
def sequential_selection(df: DataFrame, key: str, cols: Sequence[str], y: str, k: int = 3,
                         direction: str = "forward", seed: int = 42, test_share: float = 0.25) -> DataFrame:
    """I13 wrapper selection: forward (add) or backward (remove) one column
    at a time by held-out R² of a linear model; each candidate subset is a
    Spark ML fit on the cached data.  Hold-out = portable hash split."""
    base = df.select(key, y, *cols).na.drop().withColumn("__u", hash_unit(seed, F.col(key))).cache()
    train = base.where(F.col("__u") >= test_share)
    test = base.where(F.col("__u") < test_share)

    def score(subset):
        tr = assemble(train, subset)
        te = assemble(test, subset)
        return _r2(_fit_linear(tr, y), te, y)
    steps = []
    if direction == "forward":
        chosen: list[str] = []
        while len(chosen) < k:
            best = max(((score(chosen + [c]), c) for c in cols if c not in chosen), key=lambda t: (t[0], -cols.index(t[1])))
            chosen.append(best[1])
            steps.append((len(chosen), best[1], "add", float(best[0])))
    else:
        chosen = list(cols)
        while len(chosen) > k:
            best = max(((score([x for x in chosen if x != c]), c) for c in chosen), key=lambda t: (t[0], -cols.index(t[1])))
            chosen.remove(best[1])
            steps.append((len(cols) - len(chosen), best[1], "remove", float(best[0])))
    base.unpersist()
    return df.sparkSession.createDataFrame(steps, "step int, feature string, action string, r2 double")
