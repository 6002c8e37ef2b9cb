"""Registered clustering / reduction / model-workflow queries.
SQL twins exist where the result is closed-form (representatives, linear
attribution and partial dependence, contrastive loss, interpolation)."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import model as J
from ..sources.tables import table
from .registry import query
from .select import feats

XCOLS = ["l_quantity", "l_discount", "l_tax", "price_unit"]


def _feats_key(spark, sf):
    """lineitem model features (no injected nulls: models score every row)."""
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", F.col("l_linenumber").alias("line_id"), "l_returnflag",
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("y"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        F.col("l_linenumber").cast("double").alias("l_linenumber"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_unit"),
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string")).alias("row_key"))


def _emb(spark, sf):
    return table(spark, sf, "embeddings")


@query("j06_kmeans")
def j06(spark, sf):
    return J.cluster(_emb(spark, sf), "vec_id", "embedding", "kmeans", k=5)


@query("j06_bisecting_kmeans")
def j06b(spark, sf):
    return J.cluster(_emb(spark, sf), "vec_id", "embedding", "bisecting", k=5)


@query("j06_gaussian_mixture")
def j06g(spark, sf):
    return J.cluster(_emb(spark, sf), "vec_id", "embedding", "gmm", k=3)


_EUC = "sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: pow(a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE, 2))))"


@query("j06_dbscan", f"""
WITH RECURSIVE e AS (SELECT a.vec_id AS q, b.vec_id AS d FROM embeddings a JOIN embeddings b ON round({_EUC}, 9) <= 0.9),
core AS (SELECT q AS id FROM e GROUP BY q HAVING count(*) >= 5),
cc AS (SELECT q, d FROM e SEMI JOIN core a ON a.id = q SEMI JOIN core b ON b.id = d),
reach AS (SELECT id, id AS root FROM core UNION SELECT cc.d, root FROM reach JOIN cc ON cc.q = id),
lab AS (SELECT id, min(root) AS label FROM reach GROUP BY id),
border AS (SELECT q AS id, min(label) AS label FROM e JOIN lab ON lab.id = d GROUP BY q)
SELECT vec_id, coalesce(lab.label, border.label, -1) AS cluster
FROM embeddings LEFT JOIN lab ON lab.id = vec_id LEFT JOIN border ON border.id = vec_id""")
def j06d(spark, sf):
    return J.cluster(_emb(spark, sf), "vec_id", "embedding", "dbscan", eps=0.9, min_samples=5)


@query("j07_cluster_representatives", """
WITH ex AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS idx FROM embeddings),
c AS (SELECT label, idx, avg(v) AS cv FROM ex GROUP BY label, idx),
d AS (SELECT ex.vec_id, ex.label, sqrt(sum((v - cv) * (v - cv))) AS dist FROM ex JOIN c USING (label, idx) GROUP BY ex.vec_id, ex.label)
SELECT label, arg_min(vec_id, (round(dist, 9), vec_id)) AS representative_id, round(min(dist), 6) + 0.0 AS distance FROM d GROUP BY label""")
def j07(spark, sf):
    e = _emb(spark, sf)
    dim = len(e.select("embedding").first()[0])
    out = J.representatives(e, "vec_id", "embedding", "label", dim)
    return out.withColumn("distance", r6(F.col("distance")))


@query("j08_pca")
def j08(spark, sf):
    scores, ev, err = J.pca(_emb(spark, sf), "vec_id", "embedding", k=5)
    return scores.join(err, "vec_id").select("vec_id", F.transform("pc", lambda v: F.round(v, 6)).alias("pc"),
                                             r6(F.col("reconstruction_mse")).alias("reconstruction_mse"))


@query("j08_pca_target_variance")
def j08v(spark, sf):
    _, ev, _ = J.pca(_emb(spark, sf), "vec_id", "embedding", target_variance=0.8)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(ev)], "component int, explained_variance double")


@query("j08_truncated_svd")
def j08s(spark, sf):
    s = J.truncated_svd(_emb(spark, sf), "embedding", 5)
    return spark.createDataFrame([(i, v) for i, v in enumerate(s)], "component int, singular_value double")


@query("j08_lda_topics")
def j08l(spark, sf):
    return J.lda_topics(table(spark, sf, "documents"), "text", k=5, max_iter=5)


@query("j08_nmf")
def j08n(spark, sf):
    x = _emb(spark, sf).select("vec_id", F.transform("embedding", lambda v: F.abs(v.cast("double"))).alias("x"))
    w, h, losses = J.nmf(x, "vec_id", "x", rank=5, max_iter=5)
    cells = w.agg(F.count("*")).first()[0] * h.shape[1]
    return w.agg(F.lit(cells).cast("long").alias("n_cells"), F.lit((losses[-1] / cells) ** 0.5 if cells else None).cast("double").alias("rmse"),
                 F.lit(len(h)).alias("rank"))


@query("j08_pca_inverse", "SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6) + 0.0) AS restored FROM embeddings")
def j08i(spark, sf):
    e = _emb(spark, sf)
    mean, comps, _ = J.pca_fit(e, "embedding")
    out = J.pca_inverse(J.pca_transform(e, "embedding", mean, comps), "pc", mean, comps)
    return out.select("vec_id", F.transform("restored", lambda v: F.round(v, 6) + 0.0).alias("restored"))


@query("j09_train_workflow")
def j09(spark, sf):
    return J.train_workflow(_feats_key(spark, sf), "row_key", XCOLS, "y", "linear", n_folds=5)


@query("j10_regressor_menu")
def j10(spark, sf):
    return J.compare_estimators(_feats_key(spark, sf), "row_key", XCOLS, "y", "regression",
                                ["linear", "ridge", "lasso", "elasticnet", "tree", "rf", "gbt"])


@query("j10_classifier_menu")
def j10c(spark, sf):
    d = _feats_key(spark, sf)
    d = StringIndexer(inputCol="l_returnflag", outputCol="label", stringOrderType="alphabetAsc").fit(d).transform(d)
    return J.compare_estimators(d, "row_key", XCOLS, "label", "classification", ["logistic", "tree", "rf", "nb_auto"])


@query("j11_grid_search")
def j11(spark, sf):
    return J.hpo(_feats_key(spark, sf), "row_key", XCOLS, "y", "grid")


@query("j11_random_search")
def j11r(spark, sf):
    return J.hpo(_feats_key(spark, sf), "row_key", XCOLS, "y", "random", n_trials=4)


@query("j11_explore_exploit")
def j11e(spark, sf):
    return J.hpo(_feats_key(spark, sf), "row_key", XCOLS, "y", "explore", n_trials=4)


@query("j11_nested_cv")
def j11n(spark, sf):
    return J.nested_cv(_feats_key(spark, sf), "row_key", XCOLS, "y")


@query("j12_model_ensemble")
def j12(spark, sf):
    return J.ensemble(_feats_key(spark, sf), "row_key", XCOLS, "y")


# ---- linear model with closed-form twin: y = extendedprice/1000 ~ quantity + discount·100
_LIN = """t AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 1000 AS y, l_quantity AS x1, l_discount * 100 AS x2 FROM lineitem),
s AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, covar_pop(x1, x1) AS a, covar_pop(x1, x2) AS b, covar_pop(x2, x2) AS c,
   covar_pop(x1, y) AS d, covar_pop(x2, y) AS e FROM t),
beta AS (SELECT m1, m2, (c * d - b * e) / (a * c - b * b) AS b1, (a * e - b * d) / (a * c - b * b) AS b2,
   my - (c * d - b * e) / (a * c - b * b) * m1 - (a * e - b * d) / (a * c - b * b) * m2 AS b0 FROM s)"""


def _lin(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("y"),
                     F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("x2"))


@query("j13_attribution", f"""WITH {_LIN}
SELECT l_orderkey, l_linenumber, 'x1' AS feature, round(b1 * (x1 - m1), 6) + 0.0 AS attribution FROM t, beta
UNION ALL SELECT l_orderkey, l_linenumber, 'x2', round(b2 * (x2 - m2), 6) + 0.0 FROM t, beta""")
def j13(spark, sf):
    d = _lin(spark, sf)
    m = J.fit_linear(d, ["x1", "x2"], "y")
    bg = d.agg(F.avg("x1").alias("x1"), F.avg("x2").alias("x2")).first().asDict()
    out = J.attribution(d, ["l_orderkey", "l_linenumber"], ["x1", "x2"], m, bg)
    return out.withColumn("attribution", r6(F.col("attribution")))


@query("j13_counterfactual")
def j13c(spark, sf):
    d = _lin(spark, sf)
    m = J.fit_linear(d, ["x1", "x2"], "y")
    bg = d.agg(F.avg("x1").alias("x1"), F.avg("x2").alias("x2")).first().asDict()
    return J.counterfactual(d, ["l_orderkey", "l_linenumber"], ["x1", "x2"], m, bg, max_changes=3)


@query("j14_partial_dependence", f"""WITH {_LIN},
q AS (SELECT quantile_cont(x1, 0.05) AS lo, quantile_cont(x1, 0.95) AS hi FROM t),
g AS (SELECT i AS grid_index, CASE WHEN i = 49 THEN hi ELSE lo + i * ((hi - lo) / 49) END AS gv FROM q, range(0, 50) r(i))
SELECT CAST(grid_index AS INT) AS grid_index, round(gv, 6) + 0.0 AS grid_value, round(b0 + b1 * gv + b2 * m2, 6) + 0.0 AS avg_prediction FROM g, beta""")
def j14(spark, sf):
    d = _lin(spark, sf)
    m = J.fit_linear(d, ["x1", "x2"], "y")
    out = J.partial_dependence(d, ["x1", "x2"], "x1", m, 50)
    return out.select(F.col("grid_index").cast("int"), r6(F.col("grid_value")).alias("grid_value"),
                      r6(F.col("avg_prediction")).alias("avg_prediction"))


@query("j14_partial_dependence_2d", f"""WITH {_LIN},
q AS (SELECT quantile_cont(x1, 0.05) AS lo1, quantile_cont(x1, 0.95) AS hi1, quantile_cont(x2, 0.05) AS lo2, quantile_cont(x2, 0.95) AS hi2 FROM t),
g AS (SELECT i, j, lo1 + i * ((hi1 - lo1) / 5) AS a, lo2 + j * ((hi2 - lo2) / 5) AS b FROM q, range(0, 6) r(i), range(0, 6) s(j))
SELECT i::INT AS i, j::INT AS j, round(a, 6) + 0.0 AS first_value, round(b, 6) + 0.0 AS second_value, round(b0 + b1 * a + b2 * b, 6) + 0.0 AS avg_prediction FROM g, beta""")
def j14g(spark, sf):
    d = _lin(spark, sf)
    out = J.partial_dependence_2d(d, ["x1", "x2"], "x1", "x2", J.fit_linear(d, ["x1", "x2"], "y"), 6)
    return out.withColumns({c: r6(F.col(c)) for c in ("first_value", "second_value", "avg_prediction")})


@query("j14_ice")
def j14i(spark, sf):
    d = _lin(spark, sf).withColumn("rk", F.concat_ws(":", "l_orderkey", "l_linenumber", "x1", "y"))
    m = J.fit_linear(d, ["x1", "x2"], "y")
    return J.ice(d, "rk", ["x1", "x2"], "x1", m, n_samples=50)


@query("j15_bootstrap_interval")
def j15(spark, sf):
    return J.bootstrap_interval(_feats_key(spark, sf), "row_key", XCOLS, "y", n_boot=20)


@query("j15_quantile_interval")
def j15q(spark, sf):
    return J.quantile_interval(_feats_key(spark, sf), "row_key", XCOLS, "y")


@query("j15_conformal_interval")
def j15c(spark, sf):
    return J.conformal_interval(_feats_key(spark, sf), "row_key", XCOLS, "y")


@query("j16_multitask")
def j16(spark, sf):
    d = _feats_key(spark, sf).withColumn("y2", F.col("l_extendedprice") / F.col("l_quantity") / 100)
    return J.multitask(d, "row_key", ["l_quantity", "l_discount", "l_tax", "l_linenumber"], ["y", "y2"])


@query("j17_batch_predict")
def j17(spark, sf):
    d = _feats_key(spark, sf)
    cols = ["l_quantity", "l_discount", "l_tax", "price_unit"]
    pipe = Pipeline(stages=[StringIndexer(inputCol="l_returnflag", outputCol="label", stringOrderType="alphabetAsc"),
                            VectorAssembler(inputCols=cols, outputCol="features"),
                            LogisticRegression(maxIter=30)])
    m = pipe.fit(d.na.drop(subset=cols))
    return J.batch_predict(m, d, "row_key", cols)


@query("j18_rule_extraction")
def j18(spark, sf):
    return J.extract_rules(feats(spark, sf), XCOLS, "y", max_depth=3)


@query("j19_distillation")
def j19(spark, sf):
    return J.distill(_feats_key(spark, sf), "row_key", XCOLS, "y")


@query("j19_transfer_report")
def j19t(spark, sf):
    d = _feats_key(spark, sf)
    return J.transfer_report(d.where("l_returnflag = 'N'"), d.where("l_returnflag = 'R'"), "row_key", XCOLS, "y")


_NORM = "list_transform({v}, lambda x: x / (sqrt(list_sum(list_transform({v}, lambda y: y * y))) + 1e-9))"


@query("j20_contrastive_loss", f"""
WITH z AS (SELECT vec_id, {_NORM.format(v='a')} AS a, {_NORM.format(v='b')} AS b FROM (
   SELECT vec_id, list_transform(embedding[1:32], lambda x: x::DOUBLE) AS a, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS b FROM embeddings)),
s AS (SELECT p.vec_id AS i, q.vec_id AS j, list_sum(list_transform(range(1, 33), lambda k: p.a[k] * q.b[k])) / 0.1 AS s FROM z p, z q),
l AS (SELECT i, max(s) + ln(sum(exp(s - (SELECT 0)))) AS lse0, max(s) AS m FROM s GROUP BY i),
l2 AS (SELECT s.i, max(l.m) + ln(sum(exp(s.s - l.m))) AS lse FROM s JOIN l ON l.i = s.i GROUP BY s.i)
SELECT count(*) AS n, round(avg(lse - s.s), 6) + 0.0 AS loss FROM l2 JOIN s ON s.i = l2.i AND s.j = l2.i""")
def j20(spark, sf):
    e = _emb(spark, sf).select("vec_id", F.slice("embedding", 1, 32).alias("z1"), F.slice("embedding", 33, 32).alias("z2"))
    out = J.contrastive_loss(e, "vec_id", "z1", "z2", 0.1)
    return out.withColumn("loss", r6(F.col("loss")))


@query("j21_interpolation", """
SELECT a.vec_id AS id_a, b.vec_id AS id_b, CAST(st AS INT) AS step,
  list_transform(range(1, len(a.embedding) + 1), lambda i: round((1 - st / 4) * a.embedding[i]::DOUBLE + st / 4 * b.embedding[i]::DOUBLE, 6) + 0.0) AS vector
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1, range(0, 5) r(st)""")
def j21(spark, sf):
    e = _emb(spark, sf)
    a = e.withColumn("__pair", F.col("vec_id"))
    b = e.withColumn("__pair", F.col("vec_id") - 1)
    out = J.interpolate(a, b, "vec_id", "vec_id", "embedding", 5)
    return out.withColumn("vector", F.transform("vector", lambda v: F.round(v, 6) + F.lit(0.0)))
