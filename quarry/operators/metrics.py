"""Evaluation and test statistics (M01–M16).  Every metric is one pass of
mergeable partial aggregates, optionally grouped by any key; rank-based
statistics use distinct-value tables; p-values are computed on the driver
from the one-row aggregate."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.bind import bind_stats
from ..functions.stats import distinct_value_ranks, global_rank, grouped_quantile, quantiles
from ..session import cut_lineage


# ---------------------------------------------------------------- M01 / M02
def regression_metrics(df: DataFrame, y: str, p: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """M01 (+ M02 variants): mae, mse, rmse, r2, explained_variance, mape
    (fraction), mape_pct (×100, zeros skipped), r2_eps (+1e-9), median_ae,
    max_error, msle / rmsle when all values ≥ 0."""
    g = list(group_cols)
    e = F.col(y) - F.col(p)
    x = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    agg = x.groupBy(*g).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"),
        F.var_pop(F.col(y)).alias("__vy"), F.var_pop(e).alias("__ve"),
        F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(2.220446049250313e-16))).alias("mape"),
        F.avg(F.when(F.col(y) != 0, F.abs(e / F.col(y)))).alias("__mp"),
        F.max(F.abs(e)).alias("max_error"),
        F.min(F.least(F.col(y), F.col(p))).alias("__mn"),
        F.avg(F.pow(F.log1p(F.col(y)) - F.log1p(F.col(p)), 2)).alias("__msle"))
    med = grouped_quantile(x.select(*g, F.abs(e).alias("__ae")), "__ae", g, 0.5, "median_ae") if g else \
        quantiles(x.select(F.abs(e).alias("__ae")), ["__ae"], [0.5]).select(F.col("q").alias("median_ae"))
    agg = agg.join(med, g) if g else bind_stats(agg, med, "_med").withColumn("median_ae", F.col("_med.median_ae"))
    ss_res = F.col("mse") * F.col("n")
    ss_tot = F.col("__vy") * F.col("n")
    return agg.select(
        *g, "n", "mae", "mse", F.sqrt("mse").alias("rmse"),
        F.when(ss_tot > 0, 1 - ss_res / ss_tot).otherwise(F.lit(0.0)).alias("r2"),
        (1 - ss_res / (ss_tot + 1e-9)).alias("r2_eps"),
        F.when(F.col("__vy") > 0, 1 - F.col("__ve") / F.col("__vy")).otherwise(F.lit(0.0)).alias("explained_variance"),
        "mape", (F.col("__mp") * 100).alias("mape_pct"), "median_ae", "max_error",
        F.when(F.col("__mn") >= 0, F.col("__msle")).alias("msle"),
        F.when(F.col("__mn") >= 0, F.sqrt("__msle")).alias("rmsle"))


# ---------------------------------------------------------------- M03
def poisson1(u: F.Column) -> F.Column:
    """Poisson(λ=1) draw by inverse CDF of a uniform ``u`` (tail capped at 12)."""
    out = F.lit(12)
    cdf, term = 0.0, math.exp(-1.0)
    bounds = []
    for k in range(12):
        cdf += term
        bounds.append((k, cdf))
        term /= (k + 1)
    expr = None
    for k, c in bounds:
        expr = F.when(u < F.lit(c), F.lit(k)) if expr is None else expr.when(u < F.lit(c), F.lit(k))
    return expr.otherwise(out)


def poisson1_of(h: F.Column) -> F.Column:
    """``poisson1`` of the uniform of an md5 in hex (``hash_unit``), without a number parsed
    from it: a uniform is under a bound when its digits sort before the bound's."""
    cdf, term, expr = 0.0, math.exp(-1.0), None
    for k in range(12):
        cdf += term
        less = h < F.lit(f"{math.ceil(cdf * 2.0 ** 32):08x}")
        expr = F.when(less, F.lit(k)) if expr is None else expr.when(less, F.lit(k))
        term /= (k + 1)
    return expr.otherwise(F.lit(12))


def bootstrap_ci(df: DataFrame, y: str, p: str, key: F.Column, n_boot: int = 100,
                 confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Poisson bootstrap of r2 and rmse.  Every row is paired with the
    replicate ids and weighted by a seeded Poisson(1) draw per (replicate,
    row); the per-replicate sums are partially aggregated map-side, so no
    resampled copy of the data is ever shuffled (B rows per task leave it)."""
    x = df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"), key.cast("string").alias("__k"))
    x = x.select("y", F.pow(F.col("y") - F.col("p"), 2).alias("e2"), "__k")
    x = x.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    # a column of its own, so that each draw is hashed once
    x = x.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("b").cast("string"), F.lit(":"), F.col("__k"))))
    s = x.withColumn("w", poisson1_of(F.col("h")).cast("double")).groupBy("b").agg(
        F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("e2")).alias("se"), F.sum(F.col("w") * F.col("y")).alias("sy"),
        F.sum(F.col("w") * F.col("y") * F.col("y")).alias("sq"))
    reps = s.select("b", F.sqrt(F.col("se") / F.col("sw")).alias("rmse"),
                    (1 - F.try_divide(F.col("se"), F.col("sq") - F.col("sy") * F.col("sy") / F.col("sw"))).alias("r2"))
    lo, hi = (1 - confidence) / 2, 1 - (1 - confidence) / 2
    # B replicate values only: Spark's exact percentile is the right tool here
    return reps.select(F.inline(F.array(
        F.struct(F.lit("rmse").alias("metric"), F.col("rmse").alias("v")),
        F.struct(F.lit("r2").alias("metric"), F.col("r2").alias("v"))))).groupBy("metric").agg(
        F.percentile("v", lo).alias("ci_lower"), F.percentile("v", 0.5).alias("median"),
        F.percentile("v", hi).alias("ci_upper"))


# ---------------------------------------------------------------- M04 / M05
def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    """Long confusion table (y_true, y_pred, n)."""
    return df.groupBy(F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(F.count(F.lit(1)).alias("n"))


def per_class_report(conf: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, support, precision, recall, f1); zero division → 0."""
    t = conf.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"),
                                                        F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))).alias("tp"))
    pc = conf.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("pred"))
    x = t.join(pc, "label", "full").fillna(0, ["support", "tp", "pred"])
    prec = F.when(F.col("pred") > 0, F.col("tp") / F.col("pred")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    return x.select("label", F.col("tp").cast("bigint").alias("tp"), (F.col("pred") - F.col("tp")).cast("bigint").alias("fp"),
                    (F.col("support") - F.col("tp")).cast("bigint").alias("fn"), F.col("support").cast("bigint").alias("support"),
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))


def classification_metrics(df: DataFrame, y: str, p: str, positive=1) -> DataFrame:
    """Accuracy, balanced accuracy, binary / macro / weighted P R F1,
    kappa, MCC, hamming loss, jaccard (binary), specificity — all from the
    small confusion table."""
    rep = per_class_report(confusion(df, y, p))
    pos = F.col("label") == F.lit(positive)
    a = rep.agg(
        F.sum("support").alias("n"), F.sum("tp").alias("correct"),
        F.avg("recall").alias("balanced_accuracy"),
        F.avg("precision").alias("precision_macro"), F.avg("recall").alias("recall_macro"), F.avg("f1").alias("f1_macro"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision_weighted"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall_weighted"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1_weighted"),
        F.max(F.when(pos, F.col("precision"))).alias("precision"), F.max(F.when(pos, F.col("recall"))).alias("recall"),
        F.max(F.when(pos, F.col("f1"))).alias("f1"),
        F.max(F.when(pos, F.col("tp"))).alias("__tp"), F.max(F.when(pos, F.col("fp"))).alias("__fp"),
        F.max(F.when(pos, F.col("fn"))).alias("__fn"),
        F.sum(F.col("support") * (F.col("tp") + F.col("fp"))).alias("__sum_tp"),
        F.sum(F.col("support") * F.col("support")).alias("__t2"),
        F.sum((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fp"))).alias("__p2"))
    n, c = F.col("n").cast("double"), F.col("correct").cast("double")
    acc = c / n
    pe = F.col("__sum_tp") / (n * n)
    mcc_den = F.sqrt((n * n - F.col("__p2")) * (n * n - F.col("__t2")))
    tn = n - F.col("__tp") - F.col("__fp") - F.col("__fn")
    jac_den = F.col("__tp") + F.col("__fp") + F.col("__fn")
    return a.select(
        F.col("n").cast("bigint").alias("n"), acc.alias("accuracy"), "balanced_accuracy", "precision", "recall", "f1",
        "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted",
        F.when(pe < 1, (acc - pe) / (1 - pe)).otherwise(F.lit(0.0)).alias("kappa"),
        F.when(mcc_den > 0, (c * n - F.col("__sum_tp")) / mcc_den).otherwise(F.lit(0.0)).alias("mcc"),
        (1 - acc).alias("hamming_loss"),
        F.when(jac_den > 0, F.col("__tp") / jac_den).otherwise(F.lit(0.0)).alias("jaccard"),
        F.when(tn + F.col("__fp") > 0, tn / (tn + F.col("__fp"))).otherwise(F.lit(0.0)).alias("specificity"))


# ---------------------------------------------------------------- M06
def probability_metrics(df: DataFrame, y: str, score: str, eps: float = 1e-15) -> DataFrame:
    """Exact ROC-AUC (average ranks of tied scores), average precision
    (sklearn step form), Brier score and log-loss."""
    x = df.select(F.col(score).cast("double").alias("s"), (F.col(y) == 1).alias("pos"), (F.col(y) != 1).alias("neg"))
    asc = distinct_value_ranks(x, "s", ["pos", "neg"])
    auc_parts = asc.agg(F.sum(F.col("pos") * (F.col("__before") + (F.col("__cnt") + 1) / 2)).alias("r_pos"),
                        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    # one class only: no AUC
    auc = auc_parts.select(F.try_divide(F.col("r_pos") - F.col("n_pos") * (F.col("n_pos") + 1) / 2,
                                        F.col("n_pos") * F.col("n_neg")).alias("roc_auc"))
    # average precision: thresholds in descending score order; at each
    # distinct score, precision = positives so far / rows so far
    from ..functions.stats import global_rank
    desc = distinct_value_ranks(x.withColumn("s", -F.col("s")), "s", ["pos", "neg"])
    tp = global_rank(desc.select("s", "pos", F.col("__cum").alias("all_cum")), ["s"], weight_col="pos")
    ap = tp.agg(F.try_divide(F.sum(F.col("pos") * F.col("__cum") / F.col("all_cum")), F.sum("pos"))
                .alias("average_precision"))
    pc = F.least(F.greatest(F.col(score).cast("double"), F.lit(eps)), F.lit(1 - eps))
    yy = (F.col(y) == 1).cast("double")
    bl = df.agg(F.avg(F.pow(F.col(score) - yy, 2)).alias("brier"),
                (-F.avg(yy * F.log(pc) + (1 - yy) * F.log(1 - pc))).alias("log_loss"))
    out = bind_stats(auc, ap, "_a").select("roc_auc", F.col("_a.average_precision").alias("average_precision"))
    return bind_stats(out, bl, "_b").select("roc_auc", "average_precision", F.col("_b.brier").alias("brier"),
                                            F.col("_b.log_loss").alias("log_loss"))


def multiclass_auc(df: DataFrame, y: str, scores: dict[str, str]) -> DataFrame:
    """M06 for several classes: ``roc_auc_ovr`` and ``roc_auc_ovo`` (macro), exact
    with tied scores.  ``scores`` names the score column of each class.

    Each class's scores are counted by value and label; with the class's rows above a
    value known (a running sum over ranges), every pair of classes is one sum."""
    long = df.select(F.col(y).cast("string").alias("y"), F.inline(F.array(*[
        F.struct(F.lit(k).alias("c"), F.col(v).cast("double").alias("s")) for k, v in scores.items()])))
    g = long.where("s is not null and y is not null").groupBy("c", "s", "y").agg(F.count("*").alias("n"))
    g = cut_lineage(g)
    pos = g.groupBy("c", "s").agg(F.sum(F.when(F.col("y") == F.col("c"), F.col("n")).otherwise(0)).alias("pos"))
    run = global_rank(pos.withColumn("down", -F.col("s")), ["down"], ["c"], weight_col="pos")
    above = run.select("c", "s", "pos", (F.col("__cum") - F.col("pos")).alias("above"))
    u = (g.where(F.col("y") != F.col("c")).join(above, ["c", "s"])
         .groupBy("c", "y").agg(F.sum(F.col("n") * (F.col("above") + F.col("pos") / 2)).alias("u"), F.sum("n").alias("neg")))
    size = g.where(F.col("y") == F.col("c")).groupBy("c").agg(F.sum("n").alias("p"))
    u = u.join(size, "c")
    ovr = u.groupBy("c").agg((F.sum("u") / (F.first("p") * F.sum("neg"))).alias("auc")).agg(F.avg("auc").alias("roc_auc_ovr"))
    # Both directions of every pair weigh the same.
    ovo = u.agg(F.avg(F.col("u") / (F.col("p") * F.col("neg"))).alias("roc_auc_ovo"))
    return bind_stats(ovr, ovo, "_o").select("roc_auc_ovr", F.col("_o.roc_auc_ovo").alias("roc_auc_ovo"))


# ---------------------------------------------------------------- M07
def vector_long(df: DataFrame, id_col: str, vec_col: str, extra: Sequence[str] = ()) -> DataFrame:
    return df.select(id_col, *extra, F.posexplode(vec_col).alias("i", "x")).withColumn("x", F.col("x").cast("double"))


def cluster_internal(df: DataFrame, id_col: str, vec_col: str, label: str) -> DataFrame:
    """Calinski–Harabasz and Davies–Bouldin from centroid aggregates
    (exact; centroids are k × d, broadcast-sized)."""
    lg = vector_long(df, id_col, vec_col, [label])
    cen = lg.groupBy(label, "i").agg(F.avg("x").alias("c"))
    gmean = lg.groupBy("i").agg(F.avg("x").alias("g"))
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("nk"))
    # within: squared distance of each point to its centroid; dispersion s_k
    d = (lg.join(F.broadcast(cen), [label, "i"]).groupBy(id_col, label)
         .agg(F.sum(F.pow(F.col("x") - F.col("c"), 2)).alias("d2")))
    within = d.agg(F.sum("d2").alias("W"), F.count(F.lit(1)).alias("n"))
    s = d.groupBy(label).agg(F.avg(F.sqrt("d2")).alias("s"))
    between = (cen.join(F.broadcast(gmean), "i").groupBy(label).agg(F.sum(F.pow(F.col("c") - F.col("g"), 2)).alias("b2"))
               .join(sizes, label).agg(F.sum(F.col("nk") * F.col("b2")).alias("B"), F.count(F.lit(1)).alias("k")))
    c2 = cen.select(F.col(label).alias("l2"), "i", F.col("c").alias("c2"))
    # centroid pairs: k × k over k × d rows — bounded by the number of clusters
    cd = (cen.join(c2, "i").where(F.col(label) != F.col("l2")).groupBy(label, "l2")
          .agg(F.sqrt(F.sum(F.pow(F.col("c") - F.col("c2"), 2))).alias("dist")))
    s2 = s.select(F.col(label).alias("l2"), F.col("s").alias("s2"))
    db = (cd.join(s, label).join(s2, "l2").groupBy(label)
          .agg(F.max((F.col("s") + F.col("s2")) / F.col("dist")).alias("r")).agg(F.avg("r").alias("davies_bouldin")))
    row = bind_stats(within, between, "_b")
    ch = row.select(F.when((F.col("_b.k") > 1) & (F.col("W") > 0),
                           (F.col("_b.B") / (F.col("_b.k") - 1)) / (F.col("W") / (F.col("n") - F.col("_b.k"))))
                    .otherwise(F.lit(1.0)).alias("calinski_harabasz"))
    return bind_stats(ch, db, "_d").select("calinski_harabasz", F.col("_d.davies_bouldin").alias("davies_bouldin"))


def silhouette_spark(df: DataFrame, vec_col: str, label: str) -> float:
    """Spark's silhouette (squared euclidean, O(n·k) via cluster sums);
    differs from the pairwise euclidean form, stated."""
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector
    v = df.select(array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"),
                  F.col(label).cast("double").alias("prediction"))
    return ClusteringEvaluator().evaluate(v)


# ---------------------------------------------------------------- M08
def cluster_external(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rand, ARI, MI, NMI (arithmetic), homogeneity, completeness,
    V-measure, Fowlkes–Mallows from the contingency table."""
    ct = df.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("nij"))
    ra = ct.groupBy(a).agg(F.sum("nij").alias("ai"))
    rb = ct.groupBy(b).agg(F.sum("nij").alias("bj"))
    n = ct.agg(F.sum("nij").alias("n"))
    x = ct.join(ra, a).join(rb, b)
    x = bind_stats(x, n, "_n").withColumn("n", F.col("_n.n"))
    c2 = lambda c: c * (c - 1) / 2
    sums = x.agg(F.sum(c2(F.col("nij"))).alias("sij"), F.first("n").alias("n"),
                 F.sum(F.col("nij") / F.col("n") * F.log(F.col("nij") * F.col("n") / (F.col("ai") * F.col("bj")))).alias("mi"),
                 F.sum(F.col("nij") * F.col("nij")).alias("sq"))
    sa = ra.agg(F.sum(c2(F.col("ai"))).alias("sa"), F.sum(F.col("ai") * F.col("ai")).alias("a2"))
    sb = rb.agg(F.sum(c2(F.col("bj"))).alias("sb"), F.sum(F.col("bj") * F.col("bj")).alias("b2"))
    ha = bind_stats(ra, n, "_n").agg((-F.sum(F.col("ai") / F.col("_n.n") * F.log(F.col("ai") / F.col("_n.n")))).alias("ha"))
    hb = bind_stats(rb, n, "_n").agg((-F.sum(F.col("bj") / F.col("_n.n") * F.log(F.col("bj") / F.col("_n.n")))).alias("hb"))
    row = sums
    for o in (sa, sb, ha, hb):
        row = bind_stats(row, o, "_o").select(*row.columns, *[F.col(f"_o.{c}").alias(c) for c in o.columns])
    tot = c2(F.col("n"))
    exp = F.col("sa") * F.col("sb") / tot
    mx = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(mx - exp != 0, (F.col("sij") - exp) / (mx - exp)).otherwise(F.lit(1.0))
    rand = (tot + 2 * F.col("sij") - F.col("sa") - F.col("sb")) / tot
    hom = F.when(F.col("ha") > 0, F.col("mi") / F.col("ha")).otherwise(F.lit(1.0))
    com = F.when(F.col("hb") > 0, F.col("mi") / F.col("hb")).otherwise(F.lit(1.0))
    nmi = F.when((F.col("ha") + F.col("hb")) > 0, 2 * F.col("mi") / (F.col("ha") + F.col("hb"))).otherwise(F.lit(1.0))
    fmi = F.when((F.col("sa") > 0) & (F.col("sb") > 0), F.col("sij") / F.sqrt(F.col("sa") * F.col("sb"))).otherwise(F.lit(0.0))
    return row.select(rand.alias("rand_index"), ari.alias("adjusted_rand"), F.col("mi").alias("mutual_info"),
                      nmi.alias("normalized_mutual_info"), hom.alias("homogeneity"), com.alias("completeness"),
                      F.when(hom + com > 0, 2 * hom * com / (hom + com)).otherwise(F.lit(0.0)).alias("v_measure"),
                      fmi.alias("fowlkes_mallows"))


def _log_factorial(x: np.ndarray) -> np.ndarray:
    """ln x! of whole numbers."""
    z = np.maximum(x, 15).astype(float) + 1
    big = (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z ** 3) + 1 / (1260 * z ** 5)
    small = np.array([math.lgamma(k + 1) for k in range(16)])
    return np.where(x < 16, small[np.minimum(x, 15)], big)


def expected_information(a: int, b: int, n: int) -> float:
    """Expected part of the mutual information of a cluster of a rows and one of b,
    of n, under random labels: their common rows are hypergeometric.  Sizes that are
    12 standard deviations and 40 from the mean weigh less than 1e-30."""
    mean = a * b / n
    spread = math.sqrt(max(0.0, mean * (n - a) / n * (n - b) / max(1, n - 1)))
    lo = max(0, a + b - n, math.floor(mean - 12 * spread - 40))
    hi = min(a, b, math.ceil(mean + 12 * spread + 40))
    k = np.arange(lo, hi + 1)
    p = -_log_factorial(k) - _log_factorial(a - k) - _log_factorial(b - k) - _log_factorial(n - a - b + k)
    p = np.exp(p - p.max())
    some = k > 0
    k, p = k[some].astype(float), (p / p.sum())[some]
    return float((p * k / n * (np.log(k) + math.log(n) - math.log(a) - math.log(b))).sum())


def adjusted_mutual_info(df: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information, its expectation under random labels, and the
    information adjusted by it (arithmetic mean of the entropies; 1 for two
    labellings of one cluster each, and without rows).

    The expectation depends on cluster sizes only: it is summed over pairs of
    *different* sizes, of which n rows have at most about √(2n) on a side.  One
    side's sizes are broadcast, the other's are spread over the tasks."""
    spark = df.sparkSession
    ct = cut_lineage(df.groupBy(a, b).agg(F.count(F.lit(1)).alias("nij")))
    ra, rb = (ct.groupBy(c).agg(F.sum("nij").alias("size")) for c in (a, b))
    n = int(ct.agg(F.sum("nij")).first()[0] or 0)
    sizes_a, sizes_b = (x.groupBy("size").agg(F.count("*").alias("times")) for x in (ra, rb))
    held = spark.sparkContext.broadcast([(r["size"], r["times"]) for r in sizes_b.collect()])

    def run(it):
        total = 0.0
        for batch in it:
            for size, times in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total += times * sum(t * expected_information(size, s, n) for s, t in held.value)
        yield pa.RecordBatch.from_pydict({"emi": pa.array([total], pa.float64())})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    emi = sizes_a.repartition(parts, "size").mapInArrow(run, "emi double").agg(F.sum("emi")).first()[0] or 0.0
    m = ct.join(ra.withColumnRenamed("size", "ai"), a).join(rb.withColumnRenamed("size", "bj"), b)
    mi = m.agg(F.sum(F.col("nij") / n * F.log(F.col("nij") * float(n) / F.col("ai") / F.col("bj")))).first()[0] if n else 0.0
    ha, hb = (x.agg(F.count("*").alias("k"), (-F.sum(F.col("size") / n * F.log(F.col("size") / n))).alias("h")).first() if n else {"k": 0, "h": 0.0}
              for x in (ra, rb))
    if ha["k"] == hb["k"] <= 1:
        ami = 1.0
    else:
        rest = (ha["h"] + hb["h"]) / 2 - emi
        eps = float(np.finfo(float).eps)
        ami = (mi - emi) / (min(rest, -eps) if rest < 0 else max(rest, eps))
    return spark.createDataFrame([(float(mi or 0.0), float(emi), float(ami))],
                                 "mutual_info double, expected_mutual_info double, adjusted_mutual_info double")


# ---------------------------------------------------------------- M09–M11
def ab_summary(df: DataFrame, variant: str, value: str, a, b) -> DataFrame:
    """Per-variant n, mean, pop std; pooled Student t and its df; the
    Mann–Whitney U of A from average ranks over distinct values."""
    x = df.where(F.col(variant).isin(a, b))
    s = x.groupBy(variant).agg(F.count(value).alias("n"), F.avg(value).alias("m"),
                               F.stddev_pop(value).alias("sp"), F.var_samp(value).alias("vs"))
    one = s.agg(*[F.max(F.when(F.col(variant) == v, F.struct("n", "m", "sp", "vs"))).alias(t) for v, t in ((a, "A"), (b, "B"))])
    n1, n2 = F.col("A.n"), F.col("B.n")
    sp2 = F.try_divide((n1 - 1) * F.col("A.vs") + (n2 - 1) * F.col("B.vs"), n1 + n2 - 2)
    # constant values have no spread and no t
    t = F.try_divide(F.col("A.m") - F.col("B.m"),
                     F.sqrt(sp2 * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2))))
    ranks = distinct_value_ranks(x.select(F.col(value).alias("v"), (F.col(variant) == a).alias("fa"),
                                          (F.col(variant) == b).alias("fb")), "v", ["fa", "fb"])
    u = ranks.agg(F.sum(F.col("fa") * (F.col("__before") + (F.col("__cnt") + 1) / 2)).alias("r1"),
                  F.sum(F.pow(F.col("__cnt"), 3) - F.col("__cnt")).alias("ties"))
    row = bind_stats(one, u, "_u")
    return row.select(n1.alias("n_a"), n2.alias("n_b"), F.col("A.m").alias("mean_a"), F.col("B.m").alias("mean_b"),
                      F.col("A.sp").alias("std_a"), F.col("B.sp").alias("std_b"), t.alias("t_stat"),
                      (n1 + n2 - 2).alias("dof"),
                      (F.col("_u.r1") - n1 * (n1 + 1) / 2).alias("u_stat"), F.col("_u.ties").alias("tie_term"))


def ab_decision(summary_row, alpha: float = 0.05, test: str = "ttest", label_a: str = "A",
                label_b: str = "B", lower_is_better: bool = False) -> dict:
    """P-value (two-sided) and winner from the one-row summary."""
    r = summary_row
    if test == "ttest":
        p = N.t_two_sided_p(r["t_stat"], r["dof"])
    else:
        n1, n2 = r["n_a"], r["n_b"]
        mu = n1 * n2 / 2
        n = n1 + n2
        sigma = math.sqrt(n1 * n2 / 12 * ((n + 1) - r["tie_term"] / (n * (n - 1))))
        u = r["u_stat"]
        z = (abs(u - mu) - 0.5) / sigma if sigma > 0 else 0.0
        p = min(1.0, 2 * (1 - N.norm_cdf(z)))
    sig = p < alpha
    winner = None
    if sig:
        a_better = r["mean_a"] < r["mean_b"] if lower_is_better else r["mean_a"] > r["mean_b"]
        winner = label_a if a_better else label_b
    return {"p_value": p, "is_significant": sig, "winner": winner}


def effect_size(df: DataFrame, variant: str, value: str, a, b, group_cols: Sequence[str] = ()) -> DataFrame:
    """Cohen's d = (m_a − m_b)/(sqrt((var_a + var_b)/2) + 1e-9), population
    variances, optionally per segment."""
    g = list(group_cols)
    s = df.groupBy(*g).agg(
        F.avg(F.when(F.col(variant) == a, F.col(value))).alias("ma"),
        F.avg(F.when(F.col(variant) == b, F.col(value))).alias("mb"),
        F.var_pop(F.when(F.col(variant) == a, F.col(value))).alias("va"),
        F.var_pop(F.when(F.col(variant) == b, F.col(value))).alias("vb"))
    return s.select(*g, ((F.col("ma") - F.col("mb")) / (F.sqrt((F.col("va") + F.col("vb")) / 2) + 1e-9)).alias("cohen_d"))


def sample_size_required(effect: float, alpha: float = 0.05, power: float = 0.8) -> int:
    """N per arm = 2·((z_{1−α/2} + z_power)/d)²."""
    za, zb = N.norm_ppf(1 - alpha / 2), N.norm_ppf(power)
    return int(math.ceil(2 * ((za + zb) / effect) ** 2))


# ---------------------------------------------------------------- M12 / M13
def drift_baseline(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: mean, sample std, min, max."""
    one = df.agg(*[F.struct(F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"),
                            F.max(c).cast("double").alias("max")).alias(c) for c in cols])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.*")) for c in cols])))


def drift_check(baseline: DataFrame, current: DataFrame, cols: Sequence[str], threshold: float = 0.05) -> DataFrame:
    """score = |Δmean|/(std_b+1e-9) + |1 − std_c/(std_b+1e-9)|;
    drifted if score > 10·threshold."""
    cur = drift_baseline(current, cols).select("column_name", F.col("mean").alias("cm"), F.col("std").alias("cs"))
    j = baseline.join(cur, "column_name")
    score = F.abs(F.col("cm") - F.col("mean")) / (F.col("std") + 1e-9) + F.abs(1 - F.col("cs") / (F.col("std") + 1e-9))
    return j.select("column_name", score.alias("drift_score"), (score > threshold * 10).alias("is_drifted"))


HIGHER_IS_BETTER = ("r2", "accuracy", "f1")


def performance_check(baseline: DataFrame, current: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Long (metric, value) tables → degraded flags."""
    j = baseline.select("metric", F.col("value").alias("base")).join(current.select("metric", "value"), "metric")
    hib = F.col("metric").isin(*HIGHER_IS_BETTER)
    deg = F.when(hib, F.col("value") < F.col("base") * (1 - threshold)).otherwise(F.col("value") > F.col("base") * (1 + threshold))
    return j.select("metric", "base", "value", deg.alias("is_degraded"))


def interval_eval(df: DataFrame, pred: str, lower: str, upper: str, actual: str) -> DataFrame:
    """Width and coverage flag per row."""
    return df.withColumn("width", F.col(upper) - F.col(lower)).withColumn(
        "covered", F.col(actual).between(F.col(lower), F.col(upper)))
