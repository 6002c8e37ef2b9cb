"""Least-squares kernels on cross products: one pass over the table, matrices
of the number of columns on the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def summed(df: DataFrame, size: int, add: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """Sum over all Arrow batches of ``add(columns)``, an array of ``size`` numbers; a
    task sends one array.  Numeric columns come as arrays, lists as matrices."""
    def run(it):
        total = np.zeros(size)
        for b in it:
            if b.num_rows:
                total += add([c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if pa.types.is_list(c.type)
                              else c.to_numpy(zero_copy_only=False) for c in b.columns])
        yield _sparse(total)

    return _gathered(df, size, run)


def _sparse(total: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["at", "v"])


def _gathered(df: DataFrame, size: int, run) -> np.ndarray:
    out = np.zeros(size)
    for r in df.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def packed(df: DataFrame, rows: int = 16384) -> DataFrame:
    """(block): the double columns of about ``rows`` rows as one binary value, column by
    column, for passes that read the same rows again and again."""
    def run(it):
        held, size = [], 0
        for b in it:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]))
            size += b.num_rows
            if size >= rows:
                yield pa.RecordBatch.from_arrays([pa.array([np.hstack(held).tobytes()], pa.binary())], ["block"])
                held, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([np.hstack(held).tobytes()], pa.binary())], ["block"])

    return df.mapInArrow(run, "block binary")


def summed_blocks(blocks: DataFrame, width: int, size: int, add: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
    """``summed`` over the blocks of ``packed`` with ``width`` columns."""
    def run(it):
        total = np.zeros(size)
        for b in it:
            for x in b.column(0):
                total += add(list(np.frombuffer(x.as_buffer(), float).reshape(width, -1)))
        yield _sparse(total)

    return _gathered(blocks, size, run)


def gram(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows without a null or NaN, the columns' means, and the centred cross products."""
    x = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    x = x.where(" and ".join(f"c{i} is not null and not isnan(c{i})" for i in range(len(cols))))
    row = x.agg(F.count("*"), *[F.avg(f"c{i}") for i in range(len(cols))]).first()
    means = np.array([v or 0.0 for v in row[1:]])
    p = len(cols)

    def add(columns):
        m = np.column_stack(columns) - means
        return (m.T @ m).ravel()

    return row[0], means, summed(x, p * p, add).reshape(p, p)


def bayesian_ridge(n: int, means: np.ndarray, products: np.ndarray, max_iter: int = 300, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of the last column on the others: the precisions of
    noise and weights maximise the evidence, on one eigendecomposition."""
    xx, xy, yy = products[:-1, :-1], products[:-1, -1], products[-1, -1]
    values, vectors = np.linalg.eigh(xx)
    values = np.maximum(values, 0.0)
    turned = vectors.T @ xy
    small = 1e-6
    noise, weight = 1.0 / (yy / max(n, 1) + np.finfo(float).eps), 1.0
    coef = np.zeros(len(xy))
    for i in range(max_iter):
        old = coef
        coef = vectors @ (turned / (values + weight / noise))
        rest = max(0.0, yy - 2 * coef @ xy + coef @ xx @ coef)
        if i and np.abs(old - coef).sum() < tol:
            break
        known = (noise * values / (weight + noise * values)).sum()
        weight = (known + 2 * small) / ((coef ** 2).sum() + 2 * small)
        noise = (n - known + 2 * small) / (rest + 2 * small)
    return coef, float(means[-1] - coef @ means[:-1])


def weighted_moments(df: DataFrame, weights: Sequence[str], cols: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The columns' means, and per weight column (never null) the weighted cross products
    of (1, *cols) less these means, all from one pass; a null, NaN or infinite value in
    ``cols`` is an error."""
    k, p = len(weights), len(cols) + 1
    means = np.array([v or 0.0 for v in df.agg(*[F.avg(F.col(c).cast("double")) for c in cols]).first()])
    x = df.select(*[F.col(w).cast("double").alias(f"w{i}") for i, w in enumerate(weights)],
                  *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])

    def add(columns):
        m = np.column_stack([np.ones(len(columns[0])), np.column_stack(columns[k:]).astype(float) - means])
        if not np.isfinite(m).all():
            raise ValueError("values must not be null, NaN or infinite")
        return np.concatenate([((m * w[:, None]).T @ m).ravel() for w in columns[:k]])

    return means, summed(x, k * p * p, add).reshape(k, p, p)


def elastic_net(moments: np.ndarray, reg: float = 0.0, mix: float = 0.0, tol: float = 1e-12, max_iter: int = 100_000) -> np.ndarray:
    """(intercept, *coefficients) of the last column on the others by cross products of
    (1, *columns): half the mean squared error plus ``reg`` · (``mix`` · L1 + (1 − ``mix``) / 2 · L2)
    on standardised columns, as ``LinearRegression`` has it."""
    n = moments[0, 0]
    if not n > 0:
        raise ValueError("no rows to fit on")
    mean = moments[0, 1:] / n
    cov = moments[1:, 1:] / n - np.outer(mean, mean)
    var = np.diag(cov)
    # What is left of a constant column is rounding.
    sd = np.sqrt(np.where(var > 1e-14 * np.maximum(np.diag(moments)[1:] / n, 1e-300), var, 0.0))
    if sd[-1] == 0:
        return np.concatenate([[mean[-1]], np.zeros(len(mean) - 1)])
    use = np.flatnonzero(sd[:-1] > 0)
    c = cov[np.ix_(use, use)] / np.outer(sd[use], sd[use])
    xy = cov[use, -1] / sd[use] / sd[-1]
    l1, l2 = reg * mix / sd[-1], reg * (1 - mix) / sd[-1]
    b = np.linalg.lstsq(c + l2 * np.eye(len(use)), xy, rcond=1e-12)[0]
    if l1 > 0:
        for _ in range(max_iter):
            old = b.copy()
            for j in range(len(use)):
                rest = xy[j] - c[j] @ b + c[j, j] * b[j]
                b[j] = np.sign(rest) * max(abs(rest) - l1, 0.0) / (c[j, j] + l2)
            if np.abs(b - old).max(initial=0.0) <= tol:
                break
    coef = np.zeros(len(sd) - 1)
    coef[use] = b * sd[-1] / sd[use]
    return np.concatenate([[mean[-1] - coef @ mean[:-1]], coef])


def squared_error(moments: np.ndarray, model: np.ndarray) -> float:
    """Mean squared error of (intercept, *coefficients) on cross products of (1, *columns)."""
    if not moments[0, 0] > 0:
        raise ValueError("no rows to score")
    v = np.concatenate([model, [-1.0]])
    return max(0.0, float(v @ moments @ v) / moments[0, 0])
