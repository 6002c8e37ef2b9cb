"""Applicability domain (J01–J05): does a new row lie inside the training
data's domain?  Every method is a DataFrame job: k-NN edges come from the
exact pivot-cell join (null features are left out of a distance; a row without
any is outside the domain with a null distance), thresholds are exact percentiles over the training
edges, and covariance-based methods ship a p×p inverse as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import quantiles
from ..session import cut_lineage
from .neighbors import dense_topk
from .similarity import zscale, zscore_stats


def _z(train: DataFrame, test: DataFrame, id_col: str, cols: Sequence[str]):
    st = zscore_stats(train, cols)
    # scaled vectors (n × p numbers) are read by several k-NN passes: write once
    tr = cut_lineage(zscale(train.select(id_col, *cols), st, cols).select(id_col, "vec"))
    te = cut_lineage(zscale(test.select(id_col, *cols), st, cols).select(id_col, "vec"))
    return tr, te


def _mean_knn(q: DataFrame, d: DataFrame, id_col: str, k: int, exclude_self: bool) -> DataFrame:
    """Mean distance to the k nearest rows; null for a row that has no neighbour,
    as one without any feature."""
    nn = dense_topk(q, d, id_col, id_col, "vec", k, "euclidean", exclude_self=exclude_self)
    return q.select(id_col).join(nn.groupBy(F.col("qid").alias(id_col)).agg(F.avg("score").alias("distance")), id_col, "left")


def _percentile(df: DataFrame, col: str, p: float) -> float:
    row = quantiles(df.where(F.col(col).isNotNull()), [col], [p]).first()
    return None if row is None else row["q"]


def _known(c, otherwise):
    """``c``, or ``otherwise`` for a row without a distance."""
    return F.when(F.col("distance").isNull(), F.lit(otherwise)).otherwise(c)


def distance_ad(train: DataFrame, test: DataFrame, id_col: str, cols: Sequence[str], k: int = 5,
                threshold_percentile: float = 95, compat_k_plus_1: bool = False) -> DataFrame:
    """Z-scale on train, mean distance to the k nearest training rows
    (self excluded at fit); threshold = percentile of the training means;
    confidence 1 − ratio/2 clipped to [0.5, 1] inside, 1 − (ratio − 1)
    clipped to [0, 1] outside; at a threshold of 0, 1 inside and 0 outside.  ``compat_k_plus_1`` reproduces the
    reference's k+1 neighbours at predict time."""
    tr, te = _z(train, test, id_col, cols)
    fit = _mean_knn(tr, tr, id_col, k, True)
    thr = _percentile(fit, "distance", threshold_percentile / 100)
    pred = _mean_knn(te, tr, id_col, k + 1 if compat_k_plus_1 else k, False)
    # A threshold of 0 (training rows with k copies each) has nothing inside but copies.
    ratio = F.when(F.col("distance") > 0, F.lit(math.inf)).otherwise(F.lit(0.0)) if thr == 0 else F.col("distance") / F.lit(thr)
    inside = F.col("distance") <= F.lit(thr)
    conf = F.when(inside, F.least(F.lit(1.0), F.greatest(F.lit(0.5), 1 - ratio * 0.5))).otherwise(
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (ratio - 1))))
    return pred.select(id_col, "distance", _known(inside, False).alias("in_domain"), _known(conf, 0.0).alias("confidence"),
                       F.lit(thr).alias("threshold"))


def knn_ad_v2(train: DataFrame, test: DataFrame, id_col: str, cols: Sequence[str], k: int = 5,
              threshold_percentile: float = 95) -> DataFrame:
    """J02 k-NN: self included at fit (mean of the k nearest including the
    row itself); z = (d − t)/(t + 1e-9); confidence 1 when z ≤ 0 else
    max(0, 1 − z)."""
    tr, te = _z(train, test, id_col, cols)
    fit = _mean_knn(tr, tr, id_col, k, False)
    thr = _percentile(fit, "distance", threshold_percentile / 100)
    pred = _mean_knn(te, tr, id_col, k, False)
    z = (F.col("distance") - F.lit(thr)) / F.lit(thr + 1e-9)
    conf = F.when(z > 0, F.greatest(F.lit(0.0), 1 - z)).otherwise(F.lit(1.0))
    return pred.select(id_col, "distance", _known(F.col("distance") <= F.lit(thr), False).alias("in_domain"),
                       _known(F.least(F.lit(1.0), F.greatest(F.lit(0.0), conf)), 0.0).alias("confidence"), z.alias("z_score"))


def pca_box_ad(train: DataFrame, test: DataFrame, id_col: str, vec_col: str, n_components: int = 5,
               margin: float = 0.1) -> DataFrame:
    """J02 PCA box: inside when every principal score of the test row is in
    [min − m, max + m] of the training scores, m = 10 % of the span.
    (Spark's PCA does not centre; the shift is the same for train and test,
    so the decision equals the centred one.)"""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    trv = train.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("x"))
    tev = test.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("x"))
    sc = StandardScaler(inputCol="x", outputCol="xs", withMean=True, withStd=True).fit(trv)
    pca = PCA(k=n_components, inputCol="xs", outputCol="pc").fit(sc.transform(trv))
    ptr = pca.transform(sc.transform(trv)).select(vector_to_array("pc").alias("pc"))
    aggs = []
    for j in range(n_components):
        aggs += [F.min(F.col("pc")[j]).alias(f"lo{j}"), F.max(F.col("pc")[j]).alias(f"hi{j}")]
    b = ptr.agg(*aggs).first()
    pte = pca.transform(sc.transform(tev)).select(id_col, vector_to_array("pc").alias("pc"))
    cond = F.lit(True)
    for j in range(n_components):
        lo, hi = b[f"lo{j}"], b[f"hi{j}"]
        m = (hi - lo) * margin
        cond = cond & F.col("pc")[j].between(lo - m, hi + m)
    return pte.select(id_col, cond.alias("in_domain"), F.when(cond, 1.0).otherwise(0.5).alias("confidence"))


def lof_ad(train: DataFrame, test: DataFrame, id_col: str, cols: Sequence[str], k: int = 20,
           contamination: float = 0.05) -> DataFrame:
    """Local outlier factor in novelty mode (sklearn's definitions):
    k-distance of each training row, reach(p, o) = max(d, kdist(o)),
    lrd = 1/(mean reach + 1e-10), LOF = mean lrd(neighbours)/lrd(row);
    in domain when −LOF(test) ≥ percentile(−LOF(train), contamination)."""
    tr, te = _z(train, test, id_col, cols)
    ntr = tr.count()
    k = min(k, ntr - 1)
    # the training k-NN edges feed k-distance, lrd and LOF: compute them once
    e_tr = cut_lineage(dense_topk(tr, tr, id_col, id_col, "vec", k, "euclidean", exclude_self=True))
    kdist = e_tr.where(F.col("rank") == k).select(F.col("qid").alias("did"), F.col("score").alias("kd"))

    def lrd(edges):
        return (edges.join(kdist, "did").withColumn("reach", F.greatest("score", "kd"))
                .groupBy("qid").agg((F.lit(1.0) / (F.avg("reach") + F.lit(1e-10))).alias("lrd")))
    lrd_tr = lrd(e_tr)
    lrd_o = lrd_tr.select(F.col("qid").alias("did"), F.col("lrd").alias("lrd_o"))

    def lof(edges, own):
        return (edges.join(lrd_o, "did").groupBy("qid").agg(F.avg("lrd_o").alias("m"))
                .join(own, "qid").select("qid", (F.col("m") / F.col("lrd")).alias("lof")))
    lof_tr = lof(e_tr, lrd_tr)
    offset = _percentile(lof_tr.select((-F.col("lof")).alias("nlof")), "nlof", contamination)
    e_te = cut_lineage(dense_topk(te, tr, id_col, id_col, "vec", k, "euclidean"))
    lof_te = lof(e_te, lrd(e_te))
    score = F.col("lof") + F.lit(offset)  # −decision_function
    lof_te = te.select(F.col(id_col).alias("qid")).join(lof_te, "qid", "left")
    out = lof_te.select(F.col("qid").alias(id_col), "lof", score.alias("distance")).withColumn(
        "in_domain", _known((-F.col("lof") - F.lit(offset)) >= 0, False))
    mm = out.agg(F.min("distance").alias("lo"), F.max("distance").alias("hi")).first()
    conf = 1 - (F.col("distance") - F.lit(mm["lo"])) / F.lit(mm["hi"] - mm["lo"] + 1e-8)
    return out.withColumn("confidence", _known(conf, 0.0))


def leverage_ad(train: DataFrame, test: DataFrame, id_col: str, cols: Sequence[str],
                multiplier: float = 3.0, ridge: float = 1e-6) -> DataFrame:
    """Mahalanobis² with (sample cov + 1e-6·I)⁻¹; threshold
    3(p+1)/n; confidence 1 − (ratio − 1)/2 clipped to [0, 1].  One
    aggregate for means and covariances; the p×p inverse becomes literals
    of a quadratic-form Column."""
    p = len(cols)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)]
    aggs += [F.covar_samp(cols[i], cols[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]
    row = train.agg(*aggs).first()
    cov = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    try:
        inv = np.linalg.inv(cov + np.eye(p) * ridge)
    except np.linalg.LinAlgError:
        inv = np.eye(p)
    thr = multiplier * (p + 1) / row["n"]
    xc = [F.col(c).cast("double") - F.lit(row[f"m{i}"]) for i, c in enumerate(cols)]
    lev = None
    for i in range(p):
        for j in range(p):
            t = xc[i] * xc[j] * F.lit(float(inv[i, j]))
            lev = t if lev is None else lev + t
    ratio = F.col("distance") / F.lit(thr)
    return test.select(id_col, lev.alias("distance")).select(
        id_col, "distance", (F.col("distance") <= F.lit(thr)).alias("in_domain"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (ratio - 1) * 0.5)).alias("confidence"))


def vote(results: Sequence[DataFrame], id_col: str, voting: str = "majority") -> DataFrame:
    """Combine per-method results on the id: all / majority (votes ≥
    n/2) / any; confidence and distance averaged."""
    n = len(results)
    u = results[0].select(id_col, "in_domain", "confidence", "distance")
    for r in results[1:]:
        u = u.unionByName(r.select(id_col, "in_domain", "confidence", "distance"))
    g = u.groupBy(id_col).agg(F.sum(F.col("in_domain").cast("int")).alias("votes"),
                              F.avg("confidence").alias("confidence"), F.avg("distance").alias("distance"))
    need = {"all": float(n), "majority": n / 2, "any": 1.0}[voting]
    return g.withColumn("in_domain", F.col("votes") >= F.lit(need))


def coverage(result: DataFrame) -> DataFrame:
    """Share of rows inside the domain."""
    return result.agg(F.count(F.lit(1)).alias("n_total"),
                      F.sum(F.col("in_domain").cast("int")).alias("n_in_domain"),
                      F.avg(F.col("in_domain").cast("double")).alias("coverage"))
