"""UDF / batch surface.

* ``map_items`` runs a user's per-item Python function over a column in
  Arrow batches (one pandas UDF; batch size = the Arrow batch setting) and
  never fails the job on a bad item: every row gets ``value`` or ``error``.
* ``FunctionStep`` / ``ColumnSelector`` are ``pyspark.ml`` Transformers, so
  user steps compose into ordinary ``Pipeline``s next to Spark's own stages.
* ``parse_spec`` reads 'type:key=value,key=value' feature specs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, Param, Params
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


# ---------------------------------------------------------------- U01
def map_items(df: DataFrame, col: str, func: Callable[[Any], Any], return_type: T.DataType = T.DoubleType(),
              error_handler: Callable[[Any, Exception], Any] | None = None) -> DataFrame:
    """Apply ``func`` to each item of ``col``; returns ``value`` and
    ``error`` ('<Type>: <message>').  With an ``error_handler`` its return
    value replaces the failed item's value (the error is still reported)."""
    schema = T.StructType([T.StructField("value", return_type), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def run(items: pd.Series) -> pd.DataFrame:
        vals, errs = [], []
        for it in items:
            try:
                vals.append(func(it))
                errs.append(None)
            except Exception as e:  # noqa: BLE001 — isolation is the feature
                vals.append(error_handler(it, e) if error_handler else None)
                errs.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"value": vals, "error": errs})
    return df.withColumn("__r", run(F.col(col))).select("*", "__r.value", "__r.error").drop("__r")


def batch_summary(results: DataFrame) -> DataFrame:
    """Totals of a ``map_items`` result: total, successes, errors, success_rate."""
    return results.agg(F.count(F.lit(1)).alias("total"),
                       F.sum(F.col("error").isNull().cast("long")).alias("successful"),
                       F.sum(F.col("error").isNotNull().cast("long")).alias("failed")).withColumn(
        "success_rate", F.when(F.col("total") > 0, F.col("successful") / F.col("total")).otherwise(F.lit(0.0)))


# ---------------------------------------------------------------- U02
class FunctionStep(Transformer):
    """A pipeline step from a DataFrame → DataFrame function (built from
    Spark column expressions, it stays inside whole-stage codegen)."""

    def __init__(self, fn: Callable[[DataFrame], DataFrame], name: str | None = None):
        super().__init__()
        self.fn = fn
        self.name = name or getattr(fn, "__name__", "step")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fn(dataset)


class ColumnSelector(Transformer, HasInputCols):
    """Keep only the named columns (the reference's DataFrameSelector)."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.select(*self.getInputCols())


def build_pipeline(steps: Sequence[Any]) -> Pipeline:
    """Named or bare steps → a ``Pipeline``; callables become FunctionSteps."""
    stages = []
    for s in steps:
        s = s[1] if isinstance(s, tuple) else s
        stages.append(s if isinstance(s, (Transformer, Estimator)) else FunctionStep(s))
    return Pipeline(stages=stages)


def preprocessing_pipeline(cols: Sequence[str], scaler: str = "standard", n_features: int | None = None,
                           label: str | None = None, out: str = "features") -> Pipeline:
    """Median impute → assemble → scale (standard / minmax / robust / none)
    → optional k-best univariate selection."""
    from pyspark.ml.feature import (Imputer, MinMaxScaler, RobustScaler, StandardScaler,
                                    UnivariateFeatureSelector, VectorAssembler)
    imp = [f"{c}__imp" for c in cols]
    stages: list[Any] = [Imputer(inputCols=list(cols), outputCols=imp, strategy="median"),
                         VectorAssembler(inputCols=imp, outputCol="__raw")]
    scaled = "__raw"
    if scaler != "none":
        sc = {"standard": lambda: StandardScaler(inputCol="__raw", outputCol="__scaled", withMean=True, withStd=True),
              "minmax": lambda: MinMaxScaler(inputCol="__raw", outputCol="__scaled"),
              "robust": lambda: RobustScaler(inputCol="__raw", outputCol="__scaled")}[scaler]()
        stages.append(sc)
        scaled = "__scaled"
    if n_features and label:
        sel = UnivariateFeatureSelector(featuresCol=scaled, outputCol=out, labelCol=label,
                                        selectionMode="numTopFeatures").setFeatureType("continuous") \
            .setLabelType("continuous").setSelectionThreshold(n_features)
        stages.append(sel)
    else:
        stages.append(FunctionStep(lambda d: d.withColumnRenamed(scaled, out), "rename"))
    return Pipeline(stages=stages)


# ---------------------------------------------------------------- U03
def parse_spec(spec: str) -> tuple[str, dict[str, Any]]:
    """'morgan:radius=2,n_bits=2048' → ('morgan', {'radius': 2, 'n_bits': 2048});
    values become int, float or bool when they read as such."""
    kind, _, rest = spec.partition(":")
    params: dict[str, Any] = {}
    for part in filter(None, (p.strip() for p in rest.split(","))):
        k, _, v = part.partition("=")
        params[k.strip()] = _coerce(v.strip())
    return kind.strip(), params


def _coerce(v: str) -> Any:
    if v.lower() in ("true", "false"):
        return v.lower() == "true"
    for t in (int, float):
        try:
            return t(v)
        except ValueError:
            pass
    return v


class ColumnStatsExtractor(Estimator, HasInputCols, HasOutputCol):
    """Feature-extractor contract (fit once → Model with ``descriptor_names``):
    fitted column means fill missing values and centre the columns.  Fitted
    once for all batches (the reference re-fits per batch)."""

    @keyword_only
    def __init__(self, *, inputCols: Sequence[str] | None = None, outputCol: str = "descriptors"):
        super().__init__()
        self._setDefault(outputCol="descriptors")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "ColumnStatsModel":
        cols = self.getInputCols()
        row = dataset.agg(*[F.avg(c).alias(c) for c in cols]).first()
        m = ColumnStatsModel(means={c: float(row[c]) if row[c] is not None else 0.0 for c in cols})
        m._set(inputCols=cols, outputCol=self.getOutputCol())
        return m


class ColumnStatsModel(Model, HasInputCols, HasOutputCol):
    means = Param(Params._dummy(), "means", "fitted column means")

    def __init__(self, means: dict[str, float] | None = None):
        super().__init__()
        self._means = dict(means or {})

    def descriptor_names(self) -> list[str]:
        return [f"{c}_centred" for c in self.getInputCols()]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        cols = self.getInputCols()
        arr = F.array(*[(F.coalesce(F.col(c).cast("double"), F.lit(self._means[c])) - F.lit(self._means[c]))
                        for c in cols])
        return dataset.withColumn(self.getOutputCol(), arr)
