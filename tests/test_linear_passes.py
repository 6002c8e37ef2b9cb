"""Linear fits from cross products equal Spark's; all of them take a few jobs."""

import numpy as np
import pytest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.regression import LinearRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import functions as F

from quarry.functions.columns import hash_bucket, hash_unit
from quarry.operators import model as J
from quarry.operators.metrics import poisson1

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(240, 2)) * [1, 30] + [1e4, 5]
    y = 0.5 * x[:, 0] - 0.02 * x[:, 1] + rng.normal(size=240)
    rows = [(f"k{i // 2}" if i else None, float(p), float(q), 7.0, float(t)) for i, ((p, q), t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "k string, a double, b double, c double, y double").cache()


def jobs(spark, name, run):
    spark.sparkContext.setJobGroup(name, name)
    out = run()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


def test_bootstrap_equals_weighted_refits_in_few_jobs(spark, data):
    got, n = jobs(spark, "boot", lambda: J.bootstrap_interval(data, "k", COLS, "y", n_boot=7, alpha=0.2).orderBy("y").collect())
    assert n <= 8
    x = J.assemble(data, COLS)
    preds = []
    for b in range(7):
        w = x.withColumn("w", poisson1(hash_unit(f"42:{b}", F.col("k"))).cast("double"))
        m = LinearRegression(labelCol="y", weightCol="w").fit(w)
        preds.append([r["prediction"] for r in m.transform(x).orderBy("y").collect()])
    preds = np.array(preds)
    want = np.column_stack([preds.mean(axis=0), *np.quantile(preds, [0.1, 0.9], axis=0)])
    np.testing.assert_allclose([[r["mean"], r["lower"], r["upper"]] for r in got], want, rtol=1e-7)


def test_grid_equals_cross_validator_in_few_jobs(spark, data):
    got, n = jobs(spark, "grid", lambda: J.hpo(data, "k", COLS, "y", "grid").collect())
    assert n <= 8
    x = J.assemble(data.na.drop(), COLS).withColumn("fold", hash_bucket(42, F.col("k"), 3).cast("int"))
    lr = LinearRegression(labelCol="y")
    grid = [{lr.regParam: r["reg_param"], lr.elasticNetParam: r["elastic_net"]} for r in got]
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=RegressionEvaluator(labelCol="y"), foldCol="fold", numFolds=3)
    np.testing.assert_allclose([r["cv_rmse"] for r in got], cv.fit(x).avgMetrics, rtol=1e-5)


def test_null_features_are_an_error(spark, data):
    with pytest.raises(Exception, match="null, NaN or infinite"):
        J.bootstrap_interval(data.withColumn("a", F.when(F.col("k") != "k5", F.col("a"))), "k", COLS, "y", n_boot=2).collect()


def test_quantile_passes_read_blocks_not_rows(spark, monkeypatch):
    """The rows of the Newton steps are held as a few blocks of whole columns."""
    from quarry.functions.linear import packed, summed, summed_blocks

    held, cut = [], J.cut_lineage
    monkeypatch.setattr(J, "cut_lineage", lambda d: held.append(cut(d)) or held[-1])
    df = spark.range(0, 4000, 1, 2).selectExpr("id", "cast(id % 37 as double) x", "cast(id % 37 * 2 + (id * 7919) % 11 as double) y")
    b, left = J.quantile_regression(df, ["x"], "y", [0.5])
    assert held[0].count() <= 2 and left[0] <= 1e-3 and abs(b[0, 1] - 2) < 0.05
    two = df.select("x", "y")

    def add(c):
        return np.array([c[0] @ c[1], len(c[0])])
    assert np.allclose(summed_blocks(packed(two, 100), 2, 2, add), summed(two, 2, add))
