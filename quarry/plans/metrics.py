"""Registered metric / statistic queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.columns import hash_unit, r6
from ..operators import metrics as M
from ..operators import split as H
from ..operators.quality import correlation_long
from ..sources.tables import table
from .common import hunit_sql, r
from .registry import query


def _yp(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
                                             "l_extendedprice", "l_returnflag", "l_shipdate")
    p = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    j = li.join(p, li.l_partkey == p.p_partkey)
    return j.withColumn("y", F.col("l_extendedprice") / 1000).withColumn(
        "p", F.col("l_quantity") * F.col("p_retailprice") / 1000 * 0.95)


_YP_CTE = """yp AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_shipdate, l_extendedprice / 1000 AS y,
  l_quantity * p_retailprice / 1000 * 0.95 AS p FROM lineitem JOIN part ON l_partkey = p_partkey)"""

_REG_COLS = ["mae", "mse", "rmse", "r2", "r2_eps", "explained_variance", "mape", "mape_pct", "median_ae",
             "max_error", "msle", "rmsle"]


def _reg_sql(group: str | None) -> str:
    g = f"{group}, " if group else ""
    gb = f"GROUP BY {group}" if group else ""
    return f"""
WITH {_YP_CTE},
a AS (SELECT {g}count(*) AS n, avg(abs(y - p)) AS mae, avg((y - p) * (y - p)) AS mse, var_pop(y) AS vy,
        var_pop(y - p) AS ve, avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) AS mape,
        avg(CASE WHEN y <> 0 THEN abs((y - p) / y) END) AS mp, max(abs(y - p)) AS max_error,
        min(least(y, p)) AS mn, avg(pow(ln(1 + y) - ln(1 + p), 2)) AS msle0,
        quantile_cont(abs(y - p), 0.5) AS median_ae FROM yp {gb})
SELECT {g}n, {r('mae')} AS mae, {r('mse')} AS mse, {r('sqrt(mse)')} AS rmse,
  {r('CASE WHEN vy * n > 0 THEN 1 - mse * n / (vy * n) ELSE 0.0 END')} AS r2,
  {r('1 - mse * n / (vy * n + 1e-9)')} AS r2_eps,
  {r('CASE WHEN vy > 0 THEN 1 - ve / vy ELSE 0.0 END')} AS explained_variance,
  {r('mape')} AS mape, {r('mp * 100')} AS mape_pct, {r('median_ae')} AS median_ae, {r('max_error')} AS max_error,
  {r('CASE WHEN mn >= 0 THEN msle0 END')} AS msle, {r('CASE WHEN mn >= 0 THEN sqrt(msle0) END')} AS rmsle FROM a"""


@query("m01_regression_metrics", _reg_sql(None))
def m01(spark, sf):
    out = M.regression_metrics(_yp(spark, sf), "y", "p")
    return out.withColumns({c: r6(F.col(c)) for c in _REG_COLS})


@query("m01_regression_metrics_by_group", _reg_sql("l_returnflag"))
def m01b(spark, sf):
    out = M.regression_metrics(_yp(spark, sf), "y", "p", ["l_returnflag"])
    return out.withColumns({c: r6(F.col(c)) for c in _REG_COLS})


def _poisson_sql(u: str) -> str:
    cdf, term = 0.0, math.exp(-1.0)
    parts = []
    for k in range(12):
        cdf += term
        parts.append(f"WHEN {u} < {cdf!r} THEN {k}")
        term /= (k + 1)
    return "(CASE " + " ".join(parts) + " ELSE 12 END)"


_B = 100


@query("m03_bootstrap_ci", f"""
WITH {_YP_CTE},
w AS (SELECT b, y, p, CAST({_poisson_sql(hunit_sql(42, "CAST(b AS VARCHAR) || ':' || CAST(l_orderkey AS VARCHAR) || ':' || CAST(l_linenumber AS VARCHAR)"))} AS DOUBLE) AS wt
      FROM yp, range(0, {_B}) t(b)),
s AS (SELECT b, sum(wt) AS sw, sum(wt * (y - p) * (y - p)) AS se, sum(wt * y) AS sy, sum(wt * y * y) AS sq FROM w GROUP BY b),
reps AS (SELECT sqrt(se / sw) AS rmse, 1 - se / (sq - sy * sy / sw) AS r2 FROM s)
SELECT 'rmse' AS metric, {r('quantile_cont(rmse, 0.025)')} AS ci_lower, {r('quantile_cont(rmse, 0.5)')} AS median,
       {r('quantile_cont(rmse, 0.975)')} AS ci_upper FROM reps
UNION ALL SELECT 'r2', {r('quantile_cont(r2, 0.025)')}, {r('quantile_cont(r2, 0.5)')}, {r('quantile_cont(r2, 0.975)')} FROM reps""")
def m03(spark, sf):
    x = _yp(spark, sf)
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    out = M.bootstrap_ci(x, "y", "p", key, _B, 0.95, 42)
    return out.select("metric", *[r6(F.col(c)).alias(c) for c in ("ci_lower", "median", "ci_upper")])


def _cls(spark, sf):
    lab = table(spark, sf, "labels")
    d = table(spark, sf, "documents").select("doc_id", "n_chars")
    j = lab.join(d, "doc_id")
    return j.withColumn("pred", (F.col("n_chars") > 2000).cast("int")).withColumn(
        "score", 1 / (1 + F.exp(-(F.col("n_chars") - 2000) / 1000.0)))


_CLS_CTE = """c AS (SELECT l.doc_id, quality AS y, CAST(n_chars > 2000 AS INT) AS p,
  1 / (1 + exp(-(n_chars - 2000) / 1000.0)) AS s FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
conf AS (SELECT y AS y_true, p AS y_pred, count(*) AS n FROM c GROUP BY 1, 2),
t AS (SELECT y_true AS label, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp FROM conf GROUP BY 1),
pc AS (SELECT y_pred AS label, sum(n) AS pred FROM conf GROUP BY 1),
rep AS (SELECT coalesce(t.label, pc.label) AS label, coalesce(tp, 0) AS tp, coalesce(pred, 0) - coalesce(tp, 0) AS fp,
  coalesce(support, 0) - coalesce(tp, 0) AS fn, coalesce(support, 0) AS support,
  CASE WHEN coalesce(pred, 0) > 0 THEN tp / pred ELSE 0.0 END AS precision,
  CASE WHEN coalesce(support, 0) > 0 THEN tp / support ELSE 0.0 END AS recall
  FROM t FULL JOIN pc ON t.label = pc.label),
rep2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM rep)"""


@query("m05_confusion_matrix", f"WITH {_CLS_CTE} SELECT y_true, y_pred, n FROM conf")
def m05(spark, sf):
    return M.confusion(_cls(spark, sf), "quality", "pred")


@query("m05_per_class_report", f"""WITH {_CLS_CTE}
SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(support AS BIGINT) AS support,
  {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1 FROM rep2""")
def m05b(spark, sf):
    out = M.per_class_report(M.confusion(_cls(spark, sf), "quality", "pred"))
    return out.withColumns({c: r6(F.col(c)) for c in ("precision", "recall", "f1")})


_M04_COLS = ["accuracy", "balanced_accuracy", "precision", "recall", "f1", "precision_macro", "recall_macro",
             "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted", "kappa", "mcc", "hamming_loss",
             "jaccard", "specificity"]


@query("m04_classification_metrics", f"""WITH {_CLS_CTE},
a AS (SELECT sum(support) AS n, sum(tp) AS correct, avg(recall) AS balanced_accuracy,
  avg(precision) AS precision_macro, avg(recall) AS recall_macro, avg(f1) AS f1_macro,
  sum(precision * support) / sum(support) AS precision_weighted, sum(recall * support) / sum(support) AS recall_weighted,
  sum(f1 * support) / sum(support) AS f1_weighted,
  max(CASE WHEN label = 1 THEN precision END) AS precision, max(CASE WHEN label = 1 THEN recall END) AS recall,
  max(CASE WHEN label = 1 THEN f1 END) AS f1, max(CASE WHEN label = 1 THEN tp END) AS tp1,
  max(CASE WHEN label = 1 THEN fp END) AS fp1, max(CASE WHEN label = 1 THEN fn END) AS fn1,
  sum(support * (tp + fp)) AS sum_tp, sum(support * support) AS t2, sum((tp + fp) * (tp + fp)) AS p2 FROM rep2),
b AS (SELECT *, CAST(correct AS DOUBLE) / n AS acc, sum_tp / (CAST(n AS DOUBLE) * n) AS pe,
  n - tp1 - fp1 - fn1 AS tn FROM a)
SELECT CAST(n AS BIGINT) AS n, {r('acc')} AS accuracy, {r('balanced_accuracy')} AS balanced_accuracy,
  {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, {r('precision_macro')} AS precision_macro,
  {r('recall_macro')} AS recall_macro, {r('f1_macro')} AS f1_macro, {r('precision_weighted')} AS precision_weighted,
  {r('recall_weighted')} AS recall_weighted, {r('f1_weighted')} AS f1_weighted,
  {r('CASE WHEN pe < 1 THEN (acc - pe) / (1 - pe) ELSE 0.0 END')} AS kappa,
  {r('CASE WHEN (CAST(n AS DOUBLE) * n - p2) * (CAST(n AS DOUBLE) * n - t2) > 0 THEN (CAST(correct AS DOUBLE) * n - sum_tp) / sqrt((CAST(n AS DOUBLE) * n - p2) * (CAST(n AS DOUBLE) * n - t2)) ELSE 0.0 END')} AS mcc,
  {r('1 - acc')} AS hamming_loss, {r('CASE WHEN tp1 + fp1 + fn1 > 0 THEN tp1 / (tp1 + fp1 + fn1) ELSE 0.0 END')} AS jaccard,
  {r('CASE WHEN tn + fp1 > 0 THEN tn / (tn + fp1) ELSE 0.0 END')} AS specificity FROM b""")
def m04(spark, sf):
    out = M.classification_metrics(_cls(spark, sf), "quality", "pred", 1)
    return out.withColumns({c: r6(F.col(c)) for c in _M04_COLS})


@query("m06_probability_metrics", f"""WITH {_CLS_CTE},
rk AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rr FROM c),
auc AS (SELECT (sum(CASE WHEN y = 1 THEN rr END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
               / (count_if(y = 1) * count_if(y <> 1)) AS roc_auc FROM rk),
g AS (SELECT s, count_if(y = 1) AS pos, count(*) AS cnt FROM c GROUP BY s),
cu AS (SELECT pos, sum(pos) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tpc,
              sum(cnt) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS allc FROM g),
ap AS (SELECT sum(pos * tpc / allc) / sum(pos) AS average_precision FROM cu),
bl AS (SELECT avg(pow(s - CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END, 2)) AS brier,
  -avg(CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END * ln(least(greatest(s, 1e-15), 1 - 1e-15))
       + (1 - CASE WHEN y = 1 THEN 1.0 ELSE 0.0 END) * ln(1 - least(greatest(s, 1e-15), 1 - 1e-15))) AS log_loss FROM c)
SELECT {r('roc_auc')} AS roc_auc, {r('average_precision')} AS average_precision, {r('brier')} AS brier,
       {r('log_loss')} AS log_loss FROM auc, ap, bl""")
def m06(spark, sf):
    out = M.probability_metrics(_cls(spark, sf), "quality", "score")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("m07_cluster_internal", f"""
WITH lg AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
cen AS (SELECT label, i, avg(x) AS c FROM lg GROUP BY label, i),
gm AS (SELECT i, avg(x) AS g FROM lg GROUP BY i),
sz AS (SELECT label, count(*) AS nk FROM embeddings GROUP BY label),
d AS (SELECT vec_id, lg.label, sum(pow(x - c, 2)) AS d2 FROM lg JOIN cen ON lg.label = cen.label AND lg.i = cen.i GROUP BY vec_id, lg.label),
wi AS (SELECT sum(d2) AS w, count(*) AS n FROM d),
s AS (SELECT label, avg(sqrt(d2)) AS s FROM d GROUP BY label),
bt AS (SELECT sum(nk * b2) AS b, count(*) AS k FROM (SELECT label, sum(pow(c - g, 2)) AS b2 FROM cen JOIN gm USING (i) GROUP BY label) JOIN sz USING (label)),
cd AS (SELECT a.label AS l1, b.label AS l2, sqrt(sum(pow(a.c - b.c, 2))) AS dist FROM cen a JOIN cen b ON a.i = b.i AND a.label <> b.label GROUP BY 1, 2),
db AS (SELECT avg(rr) AS davies_bouldin FROM (SELECT l1, max((s1.s + s2.s) / dist) AS rr FROM cd JOIN s s1 ON s1.label = l1 JOIN s s2 ON s2.label = l2 GROUP BY l1))
SELECT {r('CASE WHEN k > 1 AND w > 0 THEN (b / (k - 1)) / (w / (n - k)) ELSE 1.0 END')} AS calinski_harabasz,
       {r('davies_bouldin')} AS davies_bouldin FROM wi, bt, db""")
def m07(spark, sf):
    out = M.cluster_internal(table(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("m08_cluster_external", f"""
WITH ct AS (SELECT lang, source, CAST(count(*) AS DOUBLE) AS nij FROM documents GROUP BY 1, 2),
ra AS (SELECT lang, sum(nij) AS ai FROM ct GROUP BY 1), rb AS (SELECT source, sum(nij) AS bj FROM ct GROUP BY 1),
nn AS (SELECT sum(nij) AS n FROM ct),
x AS (SELECT nij, ai, bj, n FROM ct JOIN ra USING (lang) JOIN rb USING (source), nn),
s AS (SELECT sum(nij * (nij - 1) / 2) AS sij, max(n) AS n, sum(nij / n * ln(nij * n / (ai * bj))) AS mi FROM x),
sa AS (SELECT sum(ai * (ai - 1) / 2) AS sa, -sum(ai / n * ln(ai / n)) AS ha FROM ra, nn),
sb AS (SELECT sum(bj * (bj - 1) / 2) AS sb, -sum(bj / n * ln(bj / n)) AS hb FROM rb, nn),
v AS (SELECT *, n * (n - 1) / 2 AS tot, CASE WHEN ha > 0 THEN mi / ha ELSE 1.0 END AS hom,
  CASE WHEN hb > 0 THEN mi / hb ELSE 1.0 END AS com FROM s, sa, sb)
SELECT {r('(tot + 2 * sij - sa - sb) / tot')} AS rand_index,
  {r('CASE WHEN (sa + sb) / 2 - sa * sb / tot <> 0 THEN (sij - sa * sb / tot) / ((sa + sb) / 2 - sa * sb / tot) ELSE 1.0 END')} AS adjusted_rand,
  {r('mi')} AS mutual_info, {r('CASE WHEN ha + hb > 0 THEN 2 * mi / (ha + hb) ELSE 1.0 END')} AS normalized_mutual_info,
  {r('hom')} AS homogeneity, {r('com')} AS completeness,
  {r('CASE WHEN hom + com > 0 THEN 2 * hom * com / (hom + com) ELSE 0.0 END')} AS v_measure,
  {r('CASE WHEN sa > 0 AND sb > 0 THEN sij / sqrt(sa * sb) ELSE 0.0 END')} AS fowlkes_mallows FROM v""")
def m08(spark, sf):
    out = M.cluster_external(table(spark, sf, "documents"), "lang", "source")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("m08_adjusted_mutual_info", f"""
WITH o AS (SELECT o_orderpriority AS a, o_orderkey % 7 AS b FROM orders WHERE o_orderkey % 3 < 2),
ct AS (SELECT a, b, count(*)::DOUBLE AS nij FROM o GROUP BY 1, 2), nn AS (SELECT sum(nij) AS n FROM ct),
ra AS (SELECT a, sum(nij) AS ai FROM ct GROUP BY 1), rb AS (SELECT b, sum(nij) AS bj FROM ct GROUP BY 1),
mi AS (SELECT sum(nij / n * ln(nij * n / (ai * bj))) AS mi FROM ct JOIN ra USING (a) JOIN rb USING (b), nn),
h AS (SELECT (SELECT -sum(ai / n * ln(ai / n)) FROM ra, nn) AS ha, (SELECT -sum(bj / n * ln(bj / n)) FROM rb, nn) AS hb),
k AS (SELECT ai, bj, n, unnest(range(greatest(1, ai + bj - n)::BIGINT, least(ai, bj)::BIGINT + 1))::DOUBLE AS x FROM ra, rb, nn),
e AS (SELECT sum(x / n * (ln(n) + ln(x) - ln(ai) - ln(bj)) * exp(lgamma(ai + 1) + lgamma(bj + 1) + lgamma(n - ai + 1) + lgamma(n - bj + 1)
  - lgamma(n + 1) - lgamma(x + 1) - lgamma(ai - x + 1) - lgamma(bj - x + 1) - lgamma(n - ai - bj + x + 1))) AS emi FROM k)
SELECT {r('mi')} AS mutual_info, {r('emi')} AS expected_mutual_info, {r('(mi - emi) / ((ha + hb) / 2 - emi)')} AS adjusted_mutual_info FROM mi, h, e""")
def m08_ami(spark, sf):
    o = table(spark, sf, "orders").where("o_orderkey % 3 < 2").select(F.col("o_orderpriority").alias("a"), (F.col("o_orderkey") % 7).alias("b"))
    out = M.adjusted_mutual_info(o, "a", "b")
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


def _class_score(c: str) -> str:
    return f"round({hunit_sql('auc' + c, 'l_orderkey * 8 + l_linenumber')} * 0.7 + CASE WHEN l_returnflag = '{c}' THEN 0.3 ELSE 0 END, 3)"


_FLAGS = ("A", "N", "R")
_AUC_PAIRS = [(a, b) for a in _FLAGS for b in (*_FLAGS, None) if a != b]


def _auc_sql(c: str, o: str | None) -> str:
    rows = f"SELECT y, s_{c} AS s FROM x" + (f" WHERE y IN ('{c}', '{o}')" if o else "")
    return (f"SELECT '{c}' AS c, {repr(o) if o else 'NULL'} AS o, (sum(CASE WHEN y = '{c}' THEN rr END) - p * (p + 1) / 2) / (p * (count(*) - p)) AS auc FROM ("
            f"SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rr, count(*) FILTER (y = '{c}') OVER () AS p FROM ({rows})) GROUP BY p")


@query("m06_multiclass_auc", "WITH x AS (SELECT l_returnflag AS y, " + ", ".join(f"{_class_score(c)} AS s_{c}" for c in _FLAGS) + " FROM lineitem), a AS ("
       + " UNION ALL ".join(_auc_sql(a, b) for a, b in _AUC_PAIRS) + f") SELECT {r('avg(auc) FILTER (o IS NULL)')} AS roc_auc_ovr, "
       f"{r('avg(auc) FILTER (o IS NOT NULL)')} AS roc_auc_ovo FROM a")
def m06_multi(spark, sf):
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("y"), *[
        F.round(hash_unit("auc" + c, key) * 0.7 + F.when(F.col("l_returnflag") == c, 0.3).otherwise(0.0), 3).alias(f"s_{c}") for c in _FLAGS])
    out = M.multiclass_auc(li, "y", {c: f"s_{c}" for c in _FLAGS})
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


@query("m07_silhouette", f"""
WITH d AS (SELECT a.vec_id, a.label AS own, b.label AS other, sum(list_sum(list_transform(range(1, len(a.embedding) + 1),
    lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2)))) AS s, count(*) AS n FROM embeddings a JOIN embeddings b ON true GROUP BY 1, 2, 3),
m AS (SELECT vec_id, max(CASE WHEN own = other THEN n END) AS size, max(CASE WHEN own = other THEN s / greatest(n - 1, 1) END) AS a,
  min(CASE WHEN own <> other THEN s / n END) AS b FROM d GROUP BY vec_id)
SELECT {r('avg(CASE WHEN size = 1 THEN 0 ELSE (b - a) / greatest(a, b) END)')} AS silhouette FROM m""")
def m07s(spark, sf):
    value = M.silhouette_spark(table(spark, sf, "embeddings"), "embedding", "label")
    return spark.createDataFrame([(value,)], "silhouette double").select(r6(F.col("silhouette")).alias("silhouette"))


def _ab_sql(src: str) -> str:
    return f"""
WITH x AS ({src}),
s AS (SELECT count_if(variant = 'A') AS n_a, count_if(variant = 'B') AS n_b,
  avg(CASE WHEN variant = 'A' THEN value END) AS mean_a, avg(CASE WHEN variant = 'B' THEN value END) AS mean_b,
  stddev_pop(CASE WHEN variant = 'A' THEN value END) AS std_a, stddev_pop(CASE WHEN variant = 'B' THEN value END) AS std_b,
  var_samp(CASE WHEN variant = 'A' THEN value END) AS va, var_samp(CASE WHEN variant = 'B' THEN value END) AS vb FROM x),
g AS (SELECT value, count_if(variant = 'A') AS fa, count(*) AS cnt FROM x GROUP BY value),
rk AS (SELECT fa, cnt, sum(cnt) OVER (ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - cnt AS before FROM g),
u AS (SELECT sum(fa * (before + (cnt + 1) / 2.0)) AS r1, sum(pow(cnt, 3) - cnt) AS ties FROM rk)
SELECT n_a, n_b, {r('mean_a')} AS mean_a, {r('mean_b')} AS mean_b, {r('std_a')} AS std_a, {r('std_b')} AS std_b,
  {r('(mean_a - mean_b) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2) * (1.0 / n_a + 1.0 / n_b))')} AS t_stat,
  n_a + n_b - 2 AS dof, {r('r1 - n_a * (n_a + 1) / 2.0')} AS u_stat, {r('ties')} AS tie_term FROM s, u"""


_EV_SRC = "SELECT CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'B' END AS variant, value FROM events"


def _ev(spark, sf):
    e = table(spark, sf, "events")
    return e.select(F.when(F.col("user_id") % 2 == 0, "A").otherwise("B").alias("variant"), "value")


def _round_ab(df):
    return df.withColumns({c: r6(F.col(c)) for c in ("mean_a", "mean_b", "std_a", "std_b", "t_stat", "u_stat", "tie_term")})


@query("m09_ab_summary", _ab_sql(_EV_SRC))
def m09(spark, sf):
    return _round_ab(M.ab_summary(_ev(spark, sf), "variant", "value", "A", "B"))


@query("m09_ab_decision")
def m09b(spark, sf):
    s = M.ab_summary(_ev(spark, sf), "variant", "value", "A", "B").first()
    rows = []
    for test in ("ttest", "mannwhitney"):
        d = M.ab_decision(s, 0.05, test)
        rows.append((test, float(s["mean_a"]), float(s["mean_b"]), float(d["p_value"]), bool(d["is_significant"]), d["winner"]))
    return spark.createDataFrame(rows, "test string, mean_a double, mean_b double, p_value double, "
                                       "is_significant boolean, winner string")


_M10_SRC = """SELECT 'A' AS variant, abs(l_extendedprice / 1000 - l_quantity * p_retailprice / 1000) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT 'B', abs(l_extendedprice / 1000 - (l_extendedprice / 1000 * 0.9 + 1)) FROM lineitem"""


@query("m10_compare_models", _ab_sql(_M10_SRC))
def m10(spark, sf):
    x = _yp(spark, sf)
    a = x.select(F.lit("A").alias("variant"), F.abs(F.col("y") - F.col("l_quantity") * F.col("p_retailprice") / 1000).alias("value"))
    li = table(spark, sf, "lineitem")
    yb = F.col("l_extendedprice") / 1000
    b = li.select(F.lit("B").alias("variant"), F.abs(yb - (yb * 0.9 + 1)).alias("value"))
    return _round_ab(M.ab_summary(a.unionByName(b), "variant", "value", "A", "B"))


@query("m11_effect_size", f"""
SELECT event_type, {r("(avg(CASE WHEN user_id % 2 = 0 THEN value END) - avg(CASE WHEN user_id % 2 = 1 THEN value END)) / (sqrt((var_pop(CASE WHEN user_id % 2 = 0 THEN value END) + var_pop(CASE WHEN user_id % 2 = 1 THEN value END)) / 2) + 1e-9)")} AS cohen_d
FROM events GROUP BY event_type""")
def m11(spark, sf):
    e = table(spark, sf, "events").withColumn("variant", F.when(F.col("user_id") % 2 == 0, "A").otherwise("B"))
    return M.effect_size(e, "variant", "value", "A", "B", ["event_type"]).withColumn("cohen_d", r6(F.col("cohen_d")))


_DRIFT_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _drift_sql():
    def stats(cond):
        return " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem WHERE {cond}"
            for c in _DRIFT_COLS)
    return f"""
WITH b AS ({stats("l_shipdate < TIMESTAMP '1997-01-01'")}), c AS ({stats("l_shipdate >= TIMESTAMP '1997-01-01'")}),
j AS (SELECT b.column_name, abs(c.m - b.m) / (b.s + 1e-9) + abs(1 - c.s / (b.s + 1e-9)) AS sc FROM b JOIN c USING (column_name))
SELECT column_name, {r('sc')} AS drift_score, sc > 0.5 AS is_drifted FROM j"""


@query("m12_drift_check", _drift_sql())
def m12(spark, sf):
    li = table(spark, sf, "lineitem")
    base = M.drift_baseline(li.where("l_shipdate < TIMESTAMP '1997-01-01'"), _DRIFT_COLS)
    out = M.drift_check(base, li.where("l_shipdate >= TIMESTAMP '1997-01-01'"), _DRIFT_COLS, 0.05)
    return out.withColumn("drift_score", r6(F.col("drift_score")))


def _perf_long(df):
    m = M.regression_metrics(df, "y", "p").select("mae", "rmse", "r2")
    return m.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("mae", "rmse", "r2")])))


@query("m13_performance_check", f"""
WITH {_YP_CTE},
b AS (SELECT avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - avg((y - p) * (y - p)) * count(*) / (var_pop(y) * count(*)) AS r2
      FROM yp WHERE l_shipdate < TIMESTAMP '1997-01-01'),
c AS (SELECT avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - avg((y - p) * (y - p)) * count(*) / (var_pop(y) * count(*)) AS r2
      FROM yp WHERE l_shipdate >= TIMESTAMP '1997-01-01')
SELECT 'mae' AS metric, {r('b.mae')} AS base, {r('c.mae')} AS value, c.mae > b.mae * 1.1 AS is_degraded FROM b, c
UNION ALL SELECT 'rmse', {r('b.rmse')}, {r('c.rmse')}, c.rmse > b.rmse * 1.1 FROM b, c
UNION ALL SELECT 'r2', {r('b.r2')}, {r('c.r2')}, c.r2 < b.r2 * (1 - 0.1) FROM b, c""")
def m13(spark, sf):
    x = _yp(spark, sf)
    base = _perf_long(x.where("l_shipdate < TIMESTAMP '1997-01-01'"))
    cur = _perf_long(x.where("l_shipdate >= TIMESTAMP '1997-01-01'"))
    out = M.performance_check(base, cur, 0.1)
    return out.withColumn("base", r6(F.col("base"))).withColumn("value", r6(F.col("value")))


_TARGETS = ["l_extendedprice", "l_quantity", "l_discount", "l_tax"]


@query("m14_task_correlation", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {r(f'corr({a}, {b})')} AS corr FROM lineitem"
    for i, a in enumerate(_TARGETS) for b in _TARGETS[i + 1:]))
def m14(spark, sf):
    return correlation_long(table(spark, sf, "lineitem"), _TARGETS).withColumn("corr", r6(F.col("corr")))


@query("m15_residual_histogram", f"""
WITH {_YP_CTE}, e AS (SELECT y - p AS res FROM yp), b AS (SELECT min(res) AS lo, max(res) AS hi FROM e)
SELECT CAST(least(floor((res - lo) / (hi - lo) * 10), 9) AS INT) AS bin, count(*) AS n FROM e, b GROUP BY 1""")
def m15(spark, sf):
    from ..functions.bind import bind_stats
    e = _yp(spark, sf).select((F.col("y") - F.col("p")).alias("res"))
    b = e.agg(F.min("res").alias("lo"), F.max("res").alias("hi"))
    x = bind_stats(e, b, "_b")
    binc = F.least(F.floor((F.col("res") - F.col("_b.lo")) / (F.col("_b.hi") - F.col("_b.lo")) * 10), F.lit(9)).cast("int")
    return x.groupBy(binc.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("m15_cv_summary", f"""
WITH {_YP_CTE},
f AS (SELECT *, {__import__('quarry.plans.common', fromlist=['hsql']).hsql(42, 'l_orderkey')} % 5 AS fold FROM yp),
s AS (SELECT fold, 1 - avg((y - p) * (y - p)) * count(*) / (var_pop(y) * count(*)) AS r2 FROM f GROUP BY fold)
SELECT {r('avg(r2)')} AS mean_score, {r('stddev_pop(r2)')} AS std_score, count(*) AS n_folds FROM s""")
def m15b(spark, sf):
    x = H.kfold(_yp(spark, sf), "l_orderkey", 5, 42)
    per = M.regression_metrics(x, "y", "p", ["fold"])
    return per.agg(r6(F.avg("r2")).alias("mean_score"), r6(F.stddev_pop("r2")).alias("std_score"),
                   F.count(F.lit(1)).alias("n_folds"))


@query("m16_interval_eval", f"""
SELECT l_orderkey, l_linenumber, {r('l_extendedprice * (1 + l_tax) - l_extendedprice * (1 - l_discount)')} AS width,
  l_quantity * 1000 BETWEEN l_extendedprice * (1 - l_discount) AND l_extendedprice * (1 + l_tax) AS covered FROM lineitem""")
def m16(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") * 1000).alias("actual"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("lo"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("hi"))
    out = M.interval_eval(li, "actual", "lo", "hi", "actual")
    return out.select("l_orderkey", "l_linenumber", r6(F.col("width")).alias("width"), "covered")


@query("m16_interval_coverage", """
SELECT round(avg(CASE WHEN l_quantity * 1000 BETWEEN l_extendedprice * (1 - l_discount) AND l_extendedprice * (1 + l_tax)
  THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM lineitem""")
def m16b(spark, sf):
    return m16(spark, sf).agg(r6(F.avg(F.col("covered").cast("double"))).alias("coverage"))


@query("m02_regression_metrics_v2", f"""SELECT n, mae, mse, rmse, r2_eps AS r2, mape_pct AS mape FROM ({_reg_sql(None)})""")
def m02(spark, sf):
    out = M.regression_metrics(_yp(spark, sf), "y", "p")
    return out.select("n", *[r6(F.col(c)).alias(c) for c in ("mae", "mse", "rmse")],
                      r6(F.col("r2_eps")).alias("r2"), r6(F.col("mape_pct")).alias("mape"))
