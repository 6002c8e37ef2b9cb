"""Clustering, reduction and model workflows (J06–J21) on ``pyspark.ml``.

Learners are Spark ML estimators fitted on one assembled, cached vector;
loops over folds, trials or targets are driver loops of Spark jobs (each
job distributed, nothing but metrics and model parameters collected).
Where Spark has no learner the docstring says what stands in.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_bucket, hash_unit
from ..functions.linear import elastic_net, gram, squared_error, weighted_moments
from ..functions.stats import quantiles
from ..session import cut_lineage
from . import neighbors
from .metrics import poisson1_of
from .similarity import dense_logsumexp
from .topics import lda_topics  # noqa: F401


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


# ---------------------------------------------------------------- J06
def dbscan(df: DataFrame, id_col: str, vec_col: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """J06 DBSCAN (``neighbors.dbscan``): label = smallest core id of the cluster, a
    border row takes the smallest label of its core neighbours, noise is −1."""
    out = neighbors.dbscan(df, id_col, vec_col, eps, min_samples)
    return out.withColumn("cluster", F.coalesce("cluster", F.lit(-1).cast(out.schema["cluster"].dataType)))


def cluster(df: DataFrame, id_col: str, vec_col: str, method: str = "kmeans", k: int = 5, seed: int = 42,
            eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Kmeans / bisecting / gmm (Spark ML) / dbscan, by name: the number of
    rows does not choose the method."""
    from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
    if method not in ("kmeans", "bisecting", "gmm", "dbscan"):
        raise ValueError(f"no clustering {method}")
    if method == "dbscan":
        return dbscan(df, id_col, vec_col, eps, min_samples)
    x = df.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    est = {"kmeans": lambda: KMeans(k=k, seed=seed), "bisecting": lambda: BisectingKMeans(k=k, seed=seed),
           "gmm": lambda: GaussianMixture(k=k, seed=seed)}[method]()
    m = est.fit(x)
    return m.transform(x).select(id_col, F.col("prediction").cast("long").alias("cluster"))


# ---------------------------------------------------------------- J07
def representatives(df: DataFrame, id_col: str, vec_col: str, label: str, dim: int) -> DataFrame:
    """Per cluster, the row nearest the centroid (ties: smaller id)."""
    v = F.col(vec_col).cast("array<double>")
    cent = df.groupBy(label).agg(F.array(*[F.avg(v[i]) for i in range(dim)]).alias("c"))
    j = df.select(id_col, label, v.alias("v")).join(cent, label)
    dist = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t))
    j = j.withColumn("d", dist)
    best = F.min_by(F.struct(F.col(id_col).alias("rid"), F.col("d").alias("dist")),
                    F.struct(F.round("d", 9), F.col(id_col)))
    return j.groupBy(label).agg(best.alias("b")).select(label, F.col("b.rid").alias("representative_id"),
                                                          F.col("b.dist").alias("distance"))


# ---------------------------------------------------------------- J08
def pca(df: DataFrame, id_col: str, vec_col: str, k: int = 5, target_variance: float | None = None):
    """J08 PCA on centred (standardised-mean) data; with ``target_variance``
    the number of components is the smallest reaching it.  Returns
    (scores frame, explained variance ratios, reconstruction MSE frame)."""
    from pyspark.ml.feature import PCA
    x = df.select(id_col, array_to_vector(F.col(vec_col).cast("array<double>")).alias("x"))
    sc = StandardScaler(inputCol="x", outputCol="xc", withMean=True, withStd=False).fit(x)
    xc = sc.transform(x)
    dim = len(x.first()["x"])
    if target_variance is not None:
        full = PCA(k=dim, inputCol="xc", outputCol="pc").fit(xc)
        cum = np.cumsum(full.explainedVariance.toArray())
        k = int(np.searchsorted(cum, target_variance) + 1)
    m = PCA(k=k, inputCol="xc", outputCol="pc").fit(xc)
    comps = m.pc.toArray()  # dim × k
    # deterministic sign: largest |loading| of each component positive
    signs = np.sign(comps[np.argmax(np.abs(comps), axis=0), range(k)])
    comps = comps * signs
    scores = xc.select(id_col, vector_to_array("xc").alias("xc"))
    cols = [F.aggregate(F.zip_with("xc", F.array(*[F.lit(float(a)) for a in comps[:, j]]), lambda a, b: a * b),
                        F.lit(0.0), lambda s, t: s + t) for j in range(k)]
    scores = scores.select(id_col, "xc", F.array(*cols).alias("pc"))
    recon = [sum((F.col("pc")[j] * F.lit(float(comps[i, j])) for j in range(k)), F.lit(0.0)) for i in range(dim)]
    err = scores.select(id_col, (F.aggregate(F.zip_with("xc", F.array(*recon), lambda a, b: (a - b) * (a - b)),
                                             F.lit(0.0), lambda s, t: s + t) / dim).alias("reconstruction_mse"))
    return scores.select(id_col, "pc"), [float(v) for v in m.explainedVariance.toArray()], err


def truncated_svd(df: DataFrame, vec_col: str, k: int = 5) -> list[float]:
    """J08 truncated SVD (uncentred): singular values via RowMatrix."""
    from pyspark.mllib.linalg import Vectors as MV
    from pyspark.mllib.linalg.distributed import RowMatrix
    rows = df.select(F.col(vec_col).cast("array<double>").alias("v")).rdd.map(lambda r: MV.dense(r["v"]))
    svd = RowMatrix(rows).computeSVD(k, computeU=False)
    return [float(s) for s in svd.s.toArray()]


def pca_fit(df: DataFrame, vec_col: str, k: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, components (k × p, the greatest loading of each positive) and explained
    variance ratios, from one pass of cross products; all components without ``k``."""
    p = len(df.select(vec_col).first()[0])
    v = F.col(vec_col).cast("array<double>")
    _, mean, c = gram(df.select(*[v[i].alias(f"x{i}") for i in range(p)]), [f"x{i}" for i in range(p)])
    values, vectors = np.linalg.eigh(c)
    order = np.argsort(-values)[:k]
    comps = vectors[:, order].T
    comps *= np.sign(comps[np.arange(len(comps)), np.argmax(np.abs(comps), axis=1)])[:, None]
    return mean, comps, np.maximum(values, 0)[order] / max(values.sum(), 1e-300)


def _mapped(df: DataFrame, col: str, out: str, fn) -> DataFrame:
    """Column ``out`` = fn(matrix of the vectors in ``col``), an Arrow batch at a time."""
    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(list(fn(np.stack(s.to_numpy()).astype(float)))) if len(s) else s
    return df.withColumn(out, run(F.col(col).cast("array<double>")))


def pca_transform(df: DataFrame, vec_col: str, mean: np.ndarray, comps: np.ndarray, out: str = "pc") -> DataFrame:
    return _mapped(df, vec_col, out, lambda x: (x - mean) @ comps.T)


def pca_inverse(df: DataFrame, score_col: str, mean: np.ndarray, comps: np.ndarray, out: str = "restored") -> DataFrame:
    """Vectors back from their scores; the nearest ones when components are left out."""
    return _mapped(df, score_col, out, lambda s: s @ comps + mean)


def nmf(df: DataFrame, id_col: str, vec_col: str, rank: int = 5, max_iter: int = 10, tol: float = 1e-4,
        seed: int = 42) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Non-negative factors W (id, w) and H (rank × p) of the vectors, and the
    squared error after each half step, which never rises.

    Coordinate updates: a row's w needs its vector, H and H Hᵀ only; the columns
    of H need Wᵀ W and Wᵀ X, one aggregate of rank × (rank + p) numbers.  Stops
    after ``max_iter`` rounds or when a round gains less than ``tol`` of the start.
    Negative values are an error, as in any non-negative factorisation; ids may have
    any type; each round is a checkpoint."""
    from ..functions.linear import summed
    x = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    row = x.agg(F.min(F.array_min("x")).alias("lo"), F.max(F.size("x")).alias("p"), F.avg(F.aggregate("x", F.lit(0.0), lambda s, v: s + v)).alias("s"),
                F.sum(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("ss")).first()
    if row["lo"] is None:
        return x.select(F.col("id").alias(id_col), F.array().cast("array<double>").alias("w")), np.zeros((rank, 0)), []
    if row["lo"] < 0:
        raise ValueError("values must not be negative")
    p, total = row["p"], float(row["ss"])
    rng = np.random.default_rng(seed)
    h = rng.random((rank, p)) * math.sqrt(max(row["s"] / p, 1e-12) / rank) + 1e-9
    cur = cut_lineage(x.withColumn("w", F.array_repeat(F.lit(0.0), rank)))
    losses: list[float] = []

    def rows_step(cur, h):
        g = h @ h.T

        @F.pandas_udf("array<double>")
        def step(x: pd.Series, w: pd.Series) -> pd.Series:
            if not len(x):
                return w
            xh, w = np.stack(x.to_numpy()).astype(float) @ h.T, np.stack(w.to_numpy()).astype(float)
            for j in range(rank):
                if g[j, j] > 0:
                    w[:, j] = np.maximum(0.0, w[:, j] + (xh[:, j] - w @ g[:, j]) / g[j, j])
            return pd.Series(list(w))
        return cut_lineage(cur.withColumn("w", step("x", "w")))

    def products(cols):
        x, w = cols
        return np.concatenate([(w.T @ w).ravel(), (w.T @ x).ravel()])

    for _ in range(max_iter):
        cur = rows_step(cur, h)
        flat = summed(cur.select("x", "w"), rank * (rank + p), products)
        ww, wx = flat[:rank * rank].reshape(rank, rank), flat[rank * rank:].reshape(rank, p)

        def loss():
            return total - 2 * float((wx * h).sum()) + float((ww * (h @ h.T)).sum())
        losses.append(loss())
        for j in range(rank):
            if ww[j, j] > 0:
                h[j] = np.maximum(0.0, h[j] + (wx[j] - ww[j] @ h) / ww[j, j])
        losses.append(loss())
        if len(losses) > 2 and losses[-3] - losses[-1] <= tol * losses[0]:
            break
    return cur.select(F.col("id").alias(id_col), "w"), h, losses


# ---------------------------------------------------------------- J09 / J10
def make_estimator(task: str, name: str, label: str = "label", features: str = "features", seed: int = 42,
                   sample: DataFrame | None = None):
    """J10 estimator menu by name.  ``nb_auto`` picks the naive-Bayes type
    from the data like the reference: binary features → bernoulli,
    non-negative integer counts → multinomial, else gaussian."""
    from pyspark.ml import classification as C
    from pyspark.ml import regression as R
    kw = {"featuresCol": features, "labelCol": label}
    if task == "regression":
        menu = {
            "linear": lambda: R.LinearRegression(**kw),
            "ridge": lambda: R.LinearRegression(regParam=0.1, elasticNetParam=0.0, **kw),
            "lasso": lambda: R.LinearRegression(regParam=0.1, elasticNetParam=1.0, **kw),
            "elasticnet": lambda: R.LinearRegression(regParam=0.1, elasticNetParam=0.5, **kw),
            "tree": lambda: R.DecisionTreeRegressor(maxDepth=6, seed=seed, **kw),
            "rf": lambda: R.RandomForestRegressor(numTrees=20, maxDepth=6, seed=seed, **kw),
            "gbt": lambda: R.GBTRegressor(maxIter=20, maxDepth=4, seed=seed, **kw),
        }
    else:
        menu = {
            "logistic": lambda: C.LogisticRegression(maxIter=50, **kw),
            "tree": lambda: C.DecisionTreeClassifier(maxDepth=6, seed=seed, **kw),
            "rf": lambda: C.RandomForestClassifier(numTrees=20, maxDepth=6, seed=seed, **kw),
            "gbt": lambda: C.GBTClassifier(maxIter=20, maxDepth=4, seed=seed, **kw),
            "nb_auto": lambda: C.NaiveBayes(modelType=_nb_type(sample, features), **kw),
        }
    if name not in menu or menu[name] is None:
        raise ValueError(f"no Spark learner for {task}/{name}")
    return menu[name]()


def _nb_type(sample: DataFrame | None, features: str) -> str:
    if sample is None:
        return "gaussian"
    arr = vector_to_array(features)
    st = sample.agg(F.min(F.array_min(arr)).alias("mn"),
                    F.max(F.size(F.array_distinct(arr))).alias("nd"),
                    F.max(F.array_max(F.transform(arr, lambda v: F.abs(v - F.round(v))))).alias("frac")).first()
    if st["nd"] <= 2 and st["mn"] >= 0:
        return "bernoulli"
    if st["mn"] >= 0 and st["frac"] == 0:
        return "multinomial"
    return "gaussian"


def regression_scores(pred: DataFrame, label: str, p: str = "prediction") -> dict[str, float]:
    r = pred.agg(F.avg((F.col(label) - F.col(p)) ** 2).alias("mse"), F.avg(F.abs(F.col(label) - F.col(p))).alias("mae"),
                 F.var_pop(label).alias("vy")).first()
    r2 = 1 - r["mse"] / r["vy"] if r["vy"] else 0.0
    return {"r2": float(r2), "rmse": float(math.sqrt(r["mse"])), "mae": float(r["mae"])}


def train_workflow(df: DataFrame, key: str, cols: Sequence[str], label: str, model: str = "linear",
                   n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Impute → scale → model, cross-validated on a portable hash
    fold column; the preprocessing is re-fitted inside every fold (the
    reference fits it once before CV, which leaks)."""
    data = df.select(key, label, *cols).withColumn("fold", hash_bucket(seed, F.col(key), n_folds)).cache()
    rows = []
    for f in range(n_folds):
        tr, te = data.where(F.col("fold") != f), data.where(F.col("fold") == f)
        pipe = Pipeline(stages=[
            Imputer(inputCols=list(cols), outputCols=[f"{c}_i" for c in cols], strategy="median"),
            VectorAssembler(inputCols=[f"{c}_i" for c in cols], outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            make_estimator("regression", model, label, "features", seed)])
        m = pipe.fit(tr)
        rows.append((f, *regression_scores(m.transform(te), label).values()))
    data.unpersist()
    arr = np.array([r[1:] for r in rows])
    rows.append((None, *[float(v) for v in arr.mean(axis=0)]))
    return df.sparkSession.createDataFrame(rows, "fold int, r2 double, rmse double, mae double")


def compare_estimators(df: DataFrame, key: str, cols: Sequence[str], label: str, task: str,
                       names: Sequence[str], seed: int = 42, test_share: float = 0.2) -> DataFrame:
    """Fit each named estimator on one cached vector, score on a hash hold-out."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    data = assemble(df.select(key, label, *cols).na.drop(), cols).withColumn("u", hash_unit(seed, F.col(key))).cache()
    tr, te = data.where(F.col("u") >= test_share), data.where(F.col("u") < test_share)
    rows = []
    for n in names:
        m = make_estimator(task, n, label, "features", seed, sample=tr).fit(tr)
        p = m.transform(te)
        if task == "regression":
            s = regression_scores(p, label)
            rows.append((n, s["r2"], s["rmse"]))
        else:
            acc = MulticlassClassificationEvaluator(labelCol=label, metricName="accuracy").evaluate(p)
            f1 = MulticlassClassificationEvaluator(labelCol=label, metricName="f1").evaluate(p)
            rows.append((n, float(acc), float(f1)))
    data.unpersist()
    names_ = ("r2", "rmse") if task == "regression" else ("accuracy", "f1")
    return df.sparkSession.createDataFrame(rows, f"model string, {names_[0]} double, {names_[1]} double")


# ---------------------------------------------------------------- J11
def hpo(df: DataFrame, key: str, cols: Sequence[str], label: str, mode: str = "grid", n_trials: int = 6,
        n_folds: int = 3, seed: int = 42) -> DataFrame:
    """Grid / random / explore-exploit search over (regParam,
    elasticNetParam) of a linear model, every trial scored by k-fold CV on a
    hash fold column; all trials kept.  A trial's fits and errors come from the
    folds' cross products, one pass over the table for all trials; a fold without rows
    is an error."""
    data = df.select(key, label, *cols).na.drop().withColumn("__fold", hash_bucket(seed, F.col(key), n_folds))
    folds = data.withColumns({f"__w{f}": (F.col("__fold") == f).cast("double") for f in range(n_folds)})
    _, moments = weighted_moments(folds, [f"__w{f}" for f in range(n_folds)], [*cols, label])
    rng = np.random.default_rng(seed)
    if mode == "grid":
        pts = [(r, e) for r in (0.0, 0.01, 0.1) for e in (0.0, 0.5)]
    elif mode == "random":
        pts = [(float(10 ** rng.uniform(-3, 0)), float(rng.uniform(0, 1))) for _ in range(n_trials)]
    else:  # explore-exploit: perturb the best so far
        pts, best = [(0.01, 0.5)], None
    trials = []

    def run(points):
        return [float(np.mean([math.sqrt(squared_error(moments[f], elastic_net(np.delete(moments, f, axis=0).sum(axis=0), r, e)))
                               for f in range(n_folds)])) for r, e in points]
    if mode in ("grid", "random"):
        for p, s in zip(pts, run(pts)):
            trials.append((len(trials), p[0], p[1], float(s)))
    else:
        s0 = run(pts)[0]
        trials.append((0, pts[0][0], pts[0][1], float(s0)))
        best = (pts[0], s0)
        while len(trials) < n_trials:
            (r, e), _ = best
            cand = (float(r * rng.choice([0.8, 1.2])), float(min(1.0, max(0.0, e * rng.choice([0.8, 1.2])))))
            s = run([cand])[0]
            trials.append((len(trials), cand[0], cand[1], float(s)))
            if s < best[1]:
                best = (cand, s)
    bi = min(range(len(trials)), key=lambda i: (trials[i][3], i))
    rows = [(t, r, e, s, t == bi) for t, r, e, s in trials]
    return df.sparkSession.createDataFrame(
        rows, "trial int, reg_param double, elastic_net double, cv_rmse double, best boolean")


def nested_cv(df: DataFrame, key: str, cols: Sequence[str], label: str, outer: int = 3, inner: int = 3,
              seed: int = 42, metric: str = "r2") -> DataFrame:
    """J11 nested CV: outer hash folds; inside each, a CV grid search on
    the training part; the chosen model scored on the outer fold with the
    given metric (the reference ignores ``scoring`` there)."""
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import LinearRegression
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
    data = assemble(df.select(key, label, *cols).na.drop(), cols).withColumns({
        "ofold": hash_bucket(f"{seed}o", F.col(key), outer).cast("int"),
        "fold": hash_bucket(f"{seed}i", F.col(key), inner).cast("int")}).cache()
    lr = LinearRegression(featuresCol="features", labelCol=label)
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1]).addGrid(lr.elasticNetParam, [0.0, 1.0]).build()
    rows = []
    for o in range(outer):
        tr, te = data.where(F.col("ofold") != o), data.where(F.col("ofold") == o)
        cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, foldCol="fold", numFolds=inner,
                            evaluator=RegressionEvaluator(labelCol=label, metricName="rmse"))
        m = cv.fit(tr)
        score = RegressionEvaluator(labelCol=label, metricName=metric).evaluate(m.bestModel.transform(te))
        rows.append((o, float(m.bestModel.getRegParam()), float(m.bestModel.getElasticNetParam()), float(score)))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, f"outer_fold int, reg_param double, elastic_net double, {metric} double")


# ---------------------------------------------------------------- J12
def ensemble(df: DataFrame, key: str, cols: Sequence[str], label: str, models: Sequence[str] = ("linear", "tree", "rf"),
             n_folds: int = 3, seed: int = 42) -> DataFrame:
    """Out-of-fold predictions of each base model (fold loop), then
    average, inverse-CV-MSE weighted average and a stacked linear meta
    model on the OOF columns; scores of every combination."""
    from pyspark.ml.regression import LinearRegression
    data = assemble(df.select(key, label, *cols).na.drop(), cols).withColumn(
        "fold", hash_bucket(seed, F.col(key), n_folds)).cache()
    oof = data.select(key, label, "fold")
    mses = {}
    for name in models:
        parts = []
        for f in range(n_folds):
            m = make_estimator("regression", name, label, "features", seed).fit(data.where(F.col("fold") != f))
            parts.append(m.transform(data.where(F.col("fold") == f)).select(key, F.col("prediction").alias(f"p_{name}")))
        u = parts[0]
        for p in parts[1:]:
            u = u.unionByName(p)
        oof = oof.join(u, key)
        mses[name] = oof.agg(F.avg((F.col(label) - F.col(f"p_{name}")) ** 2)).first()[0]
    oof = cut_lineage(oof)
    w = {n: 1 / mses[n] for n in models}
    tw = sum(w.values())
    avg = sum((F.col(f"p_{n}") for n in models), F.lit(0.0)) / len(models)
    wavg = sum((F.col(f"p_{n}") * F.lit(w[n] / tw) for n in models), F.lit(0.0))
    stack_in = assemble(oof, [f"p_{n}" for n in models], "meta")
    meta = LinearRegression(featuresCol="meta", labelCol=label, regParam=0.01, elasticNetParam=0.0).fit(stack_in)
    st = meta.transform(stack_in).withColumnRenamed("prediction", "stacked")
    res = st.withColumns({"average": avg, "weighted": wavg})
    rows = [(n, float(mses[n])) for n in models]
    for c in ("average", "weighted", "stacked"):
        rows.append((c, float(res.agg(F.avg((F.col(label) - F.col(c)) ** 2)).first()[0])))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "method string, mse double")


# ---------------------------------------------------------------- J13 / J14
def fit_linear(df: DataFrame, cols: Sequence[str], label: str):
    from pyspark.ml.regression import LinearRegression
    return LinearRegression(featuresCol="features", labelCol=label, solver="normal", regParam=0.0).fit(
        assemble(df.select(label, *cols), cols))


def _score_variants(df: DataFrame, cols: Sequence[str], model, variants: dict[str, list]) -> DataFrame:
    """Append ``pred_<name>`` for every feature-vector variant of each row:
    copies of the fitted model read different vector columns — narrow
    projections in one stage, the rows never leave their partition."""
    out = df
    for name, exprs in variants.items():
        out = out.withColumn(f"vec_{name}", array_to_vector(F.array(*[e.cast("double") for e in exprs])))
        m = model.copy().setFeaturesCol(f"vec_{name}").setPredictionCol(f"pred_{name}")
        out = m.transform(out).drop(f"vec_{name}")
    return out


def attribution(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str], model, background: dict[str, float]) -> DataFrame:
    """Prediction − prediction with one feature set to its background
    mean, for every (row, feature); all variants of a row are scored in the
    same row (no explode/regroup, no row ids)."""
    variants = {"base": [F.col(c) for c in cols]}
    for i, f in enumerate(cols):
        variants[f"f{i}"] = [F.lit(float(background[c])) if c == f else F.col(c) for c in cols]
    sc = _score_variants(df, cols, model, variants)
    arr = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col("pred_base") - F.col(f"pred_f{i}")).alias("attribution"))
                    for i, f in enumerate(cols)])
    return sc.select(*id_cols, F.inline(arr))


def counterfactual(df: DataFrame, id_cols: Sequence[str], cols: Sequence[str], model, background: dict[str, float],
                   max_changes: int = 3) -> DataFrame:
    """For the top ``max_changes`` features by |attribution| of each
    row, predictions with the feature ×1.5 and ×0.5 (all variants scored in
    the row)."""
    variants = {"base": [F.col(c) for c in cols]}
    for i, f in enumerate(cols):
        variants[f"f{i}"] = [F.lit(float(background[c])) if c == f else F.col(c) for c in cols]
        variants[f"up{i}"] = [F.col(c) * 1.5 if c == f else F.col(c) for c in cols]
        variants[f"dn{i}"] = [F.col(c) * 0.5 if c == f else F.col(c) for c in cols]
    sc = _score_variants(df, cols, model, variants)
    arr = F.array(*[F.struct(F.abs(F.col("pred_base") - F.col(f"pred_f{i}")).alias("a"), F.lit(f).alias("feature"),
                             F.col(f"pred_up{i}").alias("up"), F.col(f"pred_dn{i}").alias("dn"))
                    for i, f in enumerate(cols)])
    top = F.slice(F.array_sort(F.transform(arr, lambda x: F.struct((-x["a"]).alias("k"), x["feature"].alias("feature"),
                                                                    x["up"].alias("up"), x["dn"].alias("dn")))),
                  1, max_changes)
    rows = sc.select(*id_cols, F.explode(top).alias("t"))
    return rows.select(*id_cols, F.col("t.feature").alias("feature"),
                       F.inline(F.array(F.struct(F.lit(1.5).alias("factor"), F.col("t.up").alias("prediction")),
                                        F.struct(F.lit(0.5).alias("factor"), F.col("t.dn").alias("prediction")))))


def partial_dependence(df: DataFrame, cols: Sequence[str], feature: str, model, n_grid: int = 50,
                       lo_q: float = 0.05, hi_q: float = 0.95) -> DataFrame:
    """Grid of n points over the [5 %, 95 %] quantile span; average
    prediction with the feature set to each grid value over ALL rows.  Each
    row scores its n grid variants in place and one aggregate averages them
    (partial aggregation per task; no n-fold row blow-up, no shuffle)."""
    q = df.agg(F.percentile(feature, lo_q).alias("lo"), F.percentile(feature, hi_q).alias("hi")).first()
    grid = np.linspace(q["lo"], q["hi"], n_grid)
    variants = {f"g{i}": [F.lit(float(v)) if c == feature else F.col(c) for c in cols] for i, v in enumerate(grid)}
    sc = _score_variants(df.select(*cols), cols, model, variants)
    one = sc.agg(*[F.avg(f"pred_g{i}").alias(f"a{i}") for i in range(n_grid)])
    arr = F.array(*[F.struct(F.lit(i).alias("grid_index"), F.lit(float(v)).alias("grid_value"),
                             F.col(f"a{i}").alias("avg_prediction")) for i, v in enumerate(grid)])
    return one.select(F.inline(arr))


def partial_dependence_2d(df: DataFrame, cols: Sequence[str], first: str, second: str, model, n_grid: int = 20,
                          lo_q: float = 0.05, hi_q: float = 0.95) -> DataFrame:
    """J14 for two features: the average prediction over all rows with both set to each
    point of a grid over their quantile spans, one row of the grid a pass."""
    q = {c: [r["q"] for r in quantiles(df, [c], [lo_q, hi_q]).orderBy("p").collect()] for c in (first, second)}
    a, b = np.linspace(*q[first], n_grid), np.linspace(*q[second], n_grid)
    rows = []
    for i, u in enumerate(a):
        variants = {f"g{j}": [F.lit(float(u)) if c == first else F.lit(float(v)) if c == second else F.col(c) for c in cols] for j, v in enumerate(b)}
        one = _score_variants(df.select(*cols), cols, model, variants).agg(*[F.avg(f"pred_g{j}").alias(f"a{j}") for j in range(n_grid)]).first()
        rows += [(i, j, float(u), float(v), one[f"a{j}"]) for j, v in enumerate(b)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, first_value double, second_value double, avg_prediction double")


def ice(df: DataFrame, key: str, cols: Sequence[str], feature: str, model, n_samples: int = 50,
        n_grid: int = 20, seed: int = 42) -> DataFrame:
    """J14 ICE: curves of ``n_samples`` hash-sampled rows (the sample is the feature)."""
    q = df.agg(F.percentile(feature, 0.05).alias("lo"), F.percentile(feature, 0.95).alias("hi")).first()
    grid = np.linspace(q["lo"], q["hi"], n_grid)
    smp = df.orderBy(hash_unit(seed, F.col(key)), key).limit(n_samples)
    g = F.array(*[F.lit(float(v)) for v in grid])
    ex = smp.select(key, *cols, F.explode(g).alias("gv")).withColumn(feature, F.col("gv"))
    return model.transform(assemble(ex, cols)).select(key, "gv", "prediction")


# ---------------------------------------------------------------- J15
def bootstrap_interval(df: DataFrame, key: str, cols: Sequence[str], label: str, n_boot: int = 20,
                       alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Poisson(1)-weighted refits (the distributed bootstrap; the weighted cross
    products of all of them come from one pass), predictions gathered into an array per
    row, mean and linear-interpolated percentile interval over it.  A null, NaN or
    infinite feature or label is an error."""
    hashed = df.select(key, label, *cols).withColumns(
        {f"__w{b}": F.md5(F.concat(F.lit(f"{seed}:{b}:"), F.col(key).cast("string"))) for b in range(n_boot)})
    draws = hashed.withColumns({f"__w{b}": poisson1_of(F.col(f"__w{b}")).cast("double") for b in range(n_boot)})
    means, moments = weighted_moments(draws, [f"__w{b}" for b in range(n_boot)], [*cols, label])
    models = [elastic_net(m) for m in moments]
    for m in models:
        m[0] += means[-1] - m[1:] @ means[:-1]
    # every bootstrap model scores the rows in place: no joins
    arr = F.sort_array(F.array(*[sum((F.col(c).cast("double") * F.lit(float(v)) for c, v in zip(cols, m[1:])), F.lit(float(m[0]))) for m in models]))
    preds = df.select(key, label, arr.alias("__a"))

    def pct(p):
        pos = p * (n_boot - 1)
        lo, frac = int(math.floor(pos)), pos - math.floor(pos)
        a = F.element_at("__a", lo + 1)
        b = F.element_at("__a", min(lo + 2, n_boot))
        return a + (b - a) * F.lit(frac)
    return preds.select(key, label, (sum((F.element_at("__a", b + 1) for b in range(n_boot)), F.lit(0.0)) / n_boot).alias("mean"),
                        pct(alpha / 2).alias("lower"), pct(1 - alpha / 2).alias("upper"))


def quantile_regression(df: DataFrame, cols: Sequence[str], label: str, probs: Sequence[float], gap: float = 1e-3,
                        max_iter: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Linear quantile regressors, (intercept, coefficients) per probability, and
    the share of the loss that the duality gap leaves open.

    Damped Newton steps on a pinball loss whose corner is rounded within ± h; gradient, Hessian
    and losses of all probabilities come from one aggregate a step.  At the
    optimum of the rounded loss its slopes are feasible for the dual problem, so
    pinball loss − Σ slope · y bounds the error; h shrinks until that is less than
    ``gap`` of the loss."""
    from ..functions.linear import packed, summed_blocks
    names = [*cols, label]
    n, means, c = gram(df, names)
    k, p = len(probs), len(cols) + 1
    if n == 0:
        return np.full((k, p), np.nan), np.full(k, np.nan)
    sd = np.sqrt(np.maximum(np.diag(c) / n, 0))
    sd = np.where(sd > 0, sd, 1.0)
    x = df.select(*[((F.col(v).cast("double") - F.lit(float(means[i]))) / F.lit(float(sd[i]))).alias(f"c{i}") for i, v in enumerate(names)])
    x = cut_lineage(packed(x.where(" and ".join(f"c{i} is not null and not isnan(c{i})" for i in range(len(names))))))
    q = np.array(probs, float)
    start, *_ = np.linalg.lstsq(c[:-1, :-1] / np.outer(sd[:-1], sd[:-1]), c[:-1, -1] / sd[:-1] / sd[-1], rcond=1e-12)
    b = np.tile(np.concatenate([[0.0], start]), (k, 1))
    size = 2 + p + p * p

    def state(b, h):
        def add(columns):
            m = np.column_stack([np.ones(len(columns[0])), *columns[:-1]])
            y, out = columns[-1], []
            for t in range(k):
                r = y - m @ b[t]
                inside = np.abs(r) <= h[t]
                slope = np.where(inside, r / (2 * h[t]) + q[t] - 0.5, np.where(r > 0, q[t], q[t] - 1))
                smooth = np.where(inside, r * r / (4 * h[t]) + (q[t] - 0.5) * r + h[t] / 4, slope * r)
                exact = np.where(r > 0, q[t] * r, (q[t] - 1) * r)
                hess = m[inside].T @ m[inside] / (2 * h[t])
                out += [[smooth.sum(), exact.sum() - float(slope @ r)], m.T @ slope, hess.ravel()]
            return np.concatenate(out)
        flat = summed_blocks(x, len(names), k * size, add).reshape(k, size)
        return flat[:, 0], flat[:, 1], flat[:, 2:2 + p], flat[:, 2 + p:].reshape(k, p, p)

    h, damp = np.full(k, 1.0), np.full(k, 1e-6)
    now = state(b, h)
    for _ in range(max_iter):
        _, _, grad, hess = now
        step = np.stack([np.linalg.solve(hess[t] + damp[t] * n * np.eye(p), grad[t]) for t in range(k)])
        trial = b + step
        new = state(trial, h)
        good = new[0] <= now[0] + 1e-12 * np.abs(now[0])
        b[good] = trial[good]
        for old, fresh in zip(now, new):
            old[good] = fresh[good]
        damp = np.where(good, np.maximum(damp / 8, 1e-9), damp * 8)
        # With the slopes' products with the columns near 0 the gap is what is open.
        slack = np.abs(now[2]).max(axis=1) / n
        left = np.abs(now[1]) / np.maximum(now[0], 1e-300)
        if ((slack <= 1e-4) & (left <= gap)).all():
            break
        shrink = (slack <= 3e-3) & (left > gap)
        if shrink.any():
            h = np.where(shrink, h / 3, h)
            now = state(b, h)
    left = np.where(slack <= 1e-4, left, np.inf)
    coef = b[:, 1:] / sd[:-1] * sd[-1]
    return np.column_stack([b[:, 0] * sd[-1] + means[-1] - coef @ means[:-1], coef]), left


def quantile_interval(df: DataFrame, key: str, cols: Sequence[str], label: str, alpha: float = 0.1) -> DataFrame:
    """Median and the α/2 and 1 − α/2 quantile regressors of each row; bounds that
    cross are put in order; rows without all features have nulls."""
    b, _ = quantile_regression(df, cols, label, [alpha / 2, 0.5, 1 - alpha / 2])

    def at(t):
        v = F.lit(float(b[t, 0]))
        for i, c in enumerate(cols):
            v = v + F.col(c).cast("double") * F.lit(float(b[t, i + 1]))
        return v
    lo, mid, hi = at(0), at(1), at(2)
    return df.select(key, label, mid.alias("prediction"), F.least(lo, hi).alias("lower"), F.greatest(lo, hi).alias("upper"))


def conformal_interval(df: DataFrame, key: str, cols: Sequence[str], label: str, alpha: float = 0.1,
                       seed: int = 42) -> DataFrame:
    """split
    conformal — fit on one hash half, the (1−α) quantile of |residual| on
    the other half widens every prediction."""
    data = assemble(df.select(key, label, *cols).na.drop(), cols).withColumn("u", hash_unit(seed, F.col(key)))
    fit = data.where("u >= 0.5")
    cal = data.where("u < 0.5")
    from pyspark.ml.regression import LinearRegression
    m = LinearRegression(featuresCol="features", labelCol=label).fit(fit)
    n = cal.count()
    qlev = min(1.0, math.ceil((n + 1) * (1 - alpha)) / n)
    qr = m.transform(cal).agg(F.percentile(F.abs(F.col(label) - F.col("prediction")), qlev)).first()[0]
    out = m.transform(data)
    return out.select(key, label, "prediction", (F.col("prediction") - qr).alias("lower"),
                      (F.col("prediction") + qr).alias("upper"))


# ---------------------------------------------------------------- J16 / J17
def multitask(df: DataFrame, key: str, cols: Sequence[str], targets: Sequence[str]) -> DataFrame:
    """One linear model per target on a shared cached vector; long
    predictions (key, task, prediction)."""
    from pyspark.ml.regression import LinearRegression
    data = assemble(df.select(key, *targets, *cols).na.drop(), cols).cache()
    out = None
    for t in targets:
        m = LinearRegression(featuresCol="features", labelCol=t).fit(data)
        p = m.transform(data).select(key, F.lit(t).alias("task"), "prediction")
        out = p if out is None else out.unionByName(p)
    return out


def batch_predict(model, df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """Score a whole table with a fitted pipeline; rows that cannot be
    scored (missing features) get a null prediction and an error text
    instead of failing the job; confidence = max class probability."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    good = df.where(ok)
    bad = df.where(~ok)
    scored = model.transform(good).select(key, F.col("prediction"),
                                          F.array_max(vector_to_array("probability")).alias("confidence"),
                                          F.lit(None).cast("string").alias("error"))
    failed = bad.select(key, F.lit(None).cast("double").alias("prediction"), F.lit(None).cast("double").alias("confidence"),
                        F.lit("missing feature").alias("error"))
    return scored.unionByName(failed)


# ---------------------------------------------------------------- J18
def extract_rules(df: DataFrame, cols: Sequence[str], label: str, max_depth: int = 3, min_support: int = 5,
                  min_confidence: float = 0.0, seed: int = 42) -> DataFrame:
    """Decision-tree leaves as rules: the path conditions (walked on
    the small fitted tree), prediction, support and confidence =
    1 − std(leaf)/std(all); leaves come from ``leafCol`` in one transform +
    groupBy."""
    from pyspark.ml.regression import DecisionTreeRegressor
    data = assemble(df.select(label, *cols).na.drop(), cols)
    m = DecisionTreeRegressor(featuresCol="features", labelCol=label, maxDepth=max_depth, seed=seed, leafCol="leaf").fit(data)
    leaves = []

    def walk(node, conds):
        name = node.getClass().getSimpleName()
        if name == "LeafNode":
            leaves.append((" AND ".join(conds) if conds else "TRUE", float(node.prediction())))
            return
        sp = node.split()
        f = cols[sp.featureIndex()]
        t = float(sp.threshold())
        walk(node.leftChild(), conds + [f"{f} <= {t:.6g}"])
        walk(node.rightChild(), conds + [f"{f} > {t:.6g}"])
    walk(m._java_obj.rootNode(), [])
    gstd = data.agg(F.stddev_samp(label)).first()[0] or 1.0
    st = m.transform(data).groupBy(F.col("leaf").cast("int").alias("leaf")).agg(
        F.count(F.lit(1)).alias("support"), F.coalesce(F.stddev_samp(label), F.lit(0.0)).alias("sd"))
    rules = df.sparkSession.createDataFrame([(i, c, p) for i, (c, p) in enumerate(leaves)],
                                            "leaf int, conditions string, prediction double")
    out = rules.join(st, "leaf").withColumn("confidence", 1 - F.col("sd") / F.lit(gstd))
    return out.where((F.col("support") >= min_support) & (F.col("confidence") >= min_confidence)).select(
        "leaf", "conditions", "prediction", "support", "confidence")


# ---------------------------------------------------------------- J19
def distill(df: DataFrame, key: str, cols: Sequence[str], label: str, n_features: int = 2, seed: int = 42) -> DataFrame:
    """A random-forest teacher, a depth-3 tree student fitted on the
    teacher's predictions over the teacher's top features; scores of both
    and the student's fidelity to the teacher."""
    from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
    data = assemble(df.select(key, label, *cols).na.drop(), cols).cache()
    t = RandomForestRegressor(featuresCol="features", labelCol=label, numTrees=20, maxDepth=6, seed=seed).fit(data)
    imp = t.featureImportances.toArray()
    top = [cols[i] for i in np.argsort(-imp, kind="stable")[:n_features]]
    tp = t.transform(data).select(key, label, *cols, F.col("prediction").alias("teacher"))
    sd = assemble(tp, top, "sf")
    s = DecisionTreeRegressor(featuresCol="sf", labelCol="teacher", maxDepth=3, seed=seed).fit(sd)
    sp = s.transform(sd)
    rows = [("teacher_r2", regression_scores(tp, label, "teacher")["r2"]),
            ("student_r2", regression_scores(sp, label)["r2"]),
            ("fidelity_r2", regression_scores(sp, "teacher")["r2"]),
            ("n_student_features", float(len(top)))]
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, "metric string, value double")


def transfer_report(source: DataFrame, target: DataFrame, key: str, cols: Sequence[str], label: str,
                    seed: int = 42) -> DataFrame:
    """J19 transfer: model fitted on the source, scored on a target hold-out
    before and after refitting on the target's training part."""
    from pyspark.ml.regression import LinearRegression
    tg = assemble(target.select(key, label, *cols).na.drop(), cols).withColumn("u", hash_unit(seed, F.col(key)))
    src = assemble(source.select(label, *cols).na.drop(), cols)
    ttr, tte = tg.where("u >= 0.3"), tg.where("u < 0.3")
    m0 = LinearRegression(featuresCol="features", labelCol=label).fit(src)
    m1 = LinearRegression(featuresCol="features", labelCol=label).fit(ttr)
    return source.sparkSession.createDataFrame(
        [("before", regression_scores(m0.transform(tte), label)["r2"]),
         ("after", regression_scores(m1.transform(tte), label)["r2"])], "stage string, r2 double")


# ---------------------------------------------------------------- J20 / J21
def normalize_rows(vec: str, eps: float = 1e-9):
    v = F.col(vec).cast("array<double>")
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(eps)
    return F.transform(v, lambda x: x / n)


def contrastive_loss(df: DataFrame, id_col: str, z1: str, z2: str, temperature: float = 0.1) -> DataFrame:
    """J20 InfoNCE: rows normalised (+1e-9), s_ij = z1_i·z2_j / T, loss =
    mean_i [log Σ_j exp(s_ij) − s_ii]; the log-sum-exp over all j runs as a
    blocked, max-shifted partial reduction (no pair rows)."""
    x = df.select(id_col, normalize_rows(z1).alias("a"), normalize_rows(z2).alias("b"))
    lse = _lse(x, id_col, temperature)
    diag = x.select(F.col(id_col).alias("qid"), (F.aggregate(F.zip_with("a", "b", lambda p, q: p * q), F.lit(0.0),
                                                             lambda s, t: s + t) / temperature).alias("sii"))
    return lse.join(diag, "qid").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("lse") - F.col("sii")).alias("loss"))


def _lse(x: DataFrame, id_col: str, temperature: float) -> DataFrame:
    q = x.select(F.col(id_col).alias("id"), F.col("a").alias("v"))
    d = x.select(F.col(id_col).alias("id"), F.col("b").alias("v"))
    return dense_logsumexp(q, d, "id", "id", "v", 1.0 / temperature)


def interpolate(a: DataFrame, b: DataFrame, key_a: str, key_b: str, vec: str, n_steps: int = 5) -> DataFrame:
    """n_steps linear steps (1−α)·a + α·b, α = linspace(0, 1)."""
    j = a.select(F.col(key_a).alias("id_a"), F.col(vec).cast("array<double>").alias("va"), "__pair").join(
        b.select(F.col(key_b).alias("id_b"), F.col(vec).cast("array<double>").alias("vb"), "__pair"), "__pair")
    steps = j.select("id_a", "id_b", "va", "vb", F.explode(F.sequence(F.lit(0), F.lit(n_steps - 1))).alias("step"))
    alpha = F.col("step") / F.lit(n_steps - 1)
    return steps.select("id_a", "id_b", "step", F.zip_with("va", "vb", lambda x, y: (1 - alpha) * x + alpha * y).alias("vector"))
