"""Wrapper feature selection (I13) for least squares: sequential, floating,
exhaustive, recursive elimination with and without cross-validation.

The table is read once: per fold, the matrix of cross products of the
(centred) columns and the target.  Training matrices are differences of fold
matrices, and a column enters or leaves a model by one sweep of them, so that a
subset costs no further pass.  Folds are portable hash buckets of the key.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_bucket

#: Below this share of its own sum of squares a column adds nothing to those in.
_TINY = 1e-10


def cross_products(df: DataFrame, key: str, cols: Sequence[str], y: str, folds: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """(fold, p + 2, p + 2) sums of products of (1, columns, y), columns centred at
    their means, and the columns' means; rows with a null are left out.  Each
    task sends one matrix a fold."""
    names = [*cols, y]
    x = df.select(hash_bucket(seed, F.col(key), folds).cast("int").alias("fold"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    x = x.where(" and ".join(f"c{i} is not null and not isnan(c{i})" for i in range(len(names))))
    means = np.array([v or 0.0 for v in x.agg(*[F.avg(f"c{i}") for i in range(len(names))]).first()])
    m = len(names) + 1

    def run(it):
        total = np.zeros((folds, m, m))
        for b in it:
            fold = b.column(0).to_numpy(zero_copy_only=False)
            rows = np.column_stack([np.ones(b.num_rows), *(b.column(i + 1).to_numpy(zero_copy_only=False) - means[i] for i in range(m - 1))])
            for f in np.unique(fold):
                part = rows[fold == f]
                total[f] += part.T @ part
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total.ravel()[at])], ["at", "v"])

    out = np.zeros(folds * m * m)
    for r in x.mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out.reshape(folds, m, m), means


def sweep(a: np.ndarray, k: int) -> np.ndarray:
    """The symmetric matrix with variable k swept in: the rest are the residual
    products, its own place is −1 over its pivot."""
    d = a[k, k]
    out = a - np.outer(a[:, k], a[k]) / d
    out[k] = out[:, k] = a[k] / d
    out[k, k] = -1.0 / d
    return out


def unsweep(a: np.ndarray, k: int) -> np.ndarray:
    """``sweep`` undone."""
    d = -a[k, k]
    out = a + np.outer(a[:, k], a[k]) / d
    out[k] = out[:, k] = a[k] / d
    out[k, k] = 1.0 / d
    return out


class Folds:
    """Models on subsets of columns, one per fold, from cross products."""

    def __init__(self, products: np.ndarray):
        self.held = products
        self.train = products.sum(axis=0)[None] - products if len(products) > 1 else products
        self.p = products.shape[1] - 2
        # The constant is in every model.
        self.start = [sweep(t, 0) if t[0, 0] > 0 else None for t in self.train]
        self._known: dict[tuple[int, ...], list[np.ndarray | None]] = {(): self.start}

    def models(self, subset: Iterable[int]) -> list[np.ndarray | None]:
        """Swept training matrices, by one sweep in or out from a subset that was there;
        a column that the others determine stays out."""
        subset = tuple(sorted(subset))
        if subset not in self._known:
            less = next((s for j in subset if (s := tuple(x for x in subset if x != j)) in self._known), None)
            if less is None:
                more = next((s for j in range(self.p) if j not in subset and (s := tuple(sorted((*subset, j)))) in self._known), None)
                if more is not None:
                    j = next(x for x in more if x not in subset)
                    # What stayed out beside j may belong in without it: then start anew.
                    if all(a is None or all(a[x + 1, x + 1] < 0 for x in more) for a in self._known[more]):
                        self._known[subset] = [a if a is None else unsweep(a, j + 1) for a in self._known[more]]
                        return self._known[subset]
                less = subset[:-1]
            j = next(x for x in subset if x not in less)
            self._known[subset] = [
                a if a is None or a[j + 1, j + 1] <= _TINY * max(1e-300, t[j + 1, j + 1]) else sweep(a, j + 1)
                for a, t in zip(self.models(less), self.train)]
        return self._known[subset]

    def coefficients(self, swept: np.ndarray, subset: Iterable[int]) -> np.ndarray:
        """Of (1, columns, y): what predicts y, and −1 for y, whose product with a
        row is the negative residual."""
        b = np.zeros(self.p + 2)
        b[0] = swept[0, -1]
        for j in subset:
            if swept[j + 1, j + 1] < 0:  # swept in
                b[j + 1] = swept[j + 1, -1]
        b[-1] = -1.0
        return b

    def score(self, subset: Sequence[int]) -> float:
        """Mean over the folds of R² on the held-out rows."""
        out = []
        for a, h in zip(self.models(subset), self.held):
            n = h[0, 0]
            spread = h[-1, -1] - h[0, -1] ** 2 / n if n > 0 else 0.0
            if a is None or spread <= 0:
                continue
            b = self.coefficients(a, subset)
            out.append(1 - float(b @ h @ b) / spread)
        return float(np.mean(out)) if out else float("nan")


def _best(scored: Iterable[tuple[float, tuple[int, ...]]]) -> tuple[float, tuple[int, ...]]:
    """Highest score rounded to 9 digits; ties to the first columns."""
    return min(scored, key=lambda t: (-round(t[0], 9), t[1]))


def select_features(df: DataFrame, key: str, cols: Sequence[str], y: str, method: str = "sfs", k: int = 3, folds: int = 5,
                    seed: int = 42, least: int = 1) -> DataFrame:
    """(size, features, score, selected): the best subset of each size that the search
    went through, by mean held-out R², and which is chosen.

    ``sfs`` / ``sbs`` add / remove the column that leaves the best score until k are
    in; ``sffs`` / ``sbfs`` after each step take columns out (or back in) as long as
    that beats the best known subset of that size; ``efs`` tries all subsets of
    ``least`` to k columns and chooses the best of all.  Ties: first columns."""
    f = Folds(cross_products(df, key, cols, y, folds, seed)[0])
    p = len(cols)
    if not 1 <= k <= p:
        raise ValueError("k must be from 1 to the number of columns")
    if method == "efs":
        table = {s: _best((f.score(c), c) for c in itertools.combinations(range(p), s)) for s in range(least, k + 1)}
        size = min(table, key=lambda s: (-round(table[s][0], 9), s))
    elif method in ("sfs", "sffs", "sbs", "sbfs"):
        grow = method in ("sfs", "sffs")
        now: tuple[int, ...] = () if grow else tuple(range(p))
        table = {} if grow else {p: (f.score(now), now)}

        def step(s, more):
            near = [tuple(sorted({*s, j})) for j in range(p) if j not in s] if more else [tuple(x for x in s if x != j) for j in s]
            return _best((f.score(c), c) for c in near)

        while len(now) != k:
            found = step(now, grow)
            now = found[1]
            if len(now) not in table or found[0] > table[len(now)][0]:
                table[len(now)] = found
            elif method in ("sffs", "sbfs"):
                now = table[len(now)][1]
            while method in ("sffs", "sbfs") and (len(now) > 2 if grow else len(now) < p - 1):
                found = step(now, not grow)
                if found[0] <= table[len(found[1])][0] + 1e-12:
                    break
                now = found[1]
                table[len(now)] = found
        size = k
    else:
        raise ValueError(method)
    rows = [(s, [cols[j] for j in t[1]], float(t[0]), s == size) for s, t in sorted(table.items())]
    return df.sparkSession.createDataFrame(rows, "size int, features array<string>, score double, selected boolean")


def _eliminate(f: Folds, fold: int, p: int, step: int, least: int) -> list[tuple[int, ...]]:
    """Subsets on the way down: the columns with the least |coefficient| leave, the
    last ones of ties first."""
    subset = tuple(range(p))
    way = [subset]
    while len(subset) > least:
        a = f.models(subset)[fold]
        b = np.round(np.abs(f.coefficients(a, subset)), 12)
        out = sorted(subset, key=lambda j: (b[j + 1], -j))[:min(step, len(subset) - least)]
        subset = tuple(j for j in subset if j not in out)
        way.append(subset)
    return way


def recursive_elimination(df: DataFrame, key: str, cols: Sequence[str], y: str, k: int | None = None, step: int = 1, folds: int = 1,
                          seed: int = 42) -> DataFrame:
    """(feature, ranking, selected): columns leave by their coefficient's size, ``step``
    at a time, until k are left (half by default); those have ranking 1, what left
    last 2.  With ``folds`` > 1 the number to keep is that with the best mean held-out R²
    of eliminations made in each fold (ties: fewer), as recursive elimination with
    cross-validation does, and ``k`` is the least number."""
    products = cross_products(df, key, cols, y, max(1, folds), seed)[0]
    p = len(cols)
    if folds > 1:
        f, scores = Folds(products), {}
        for fold in range(folds):
            h = f.held[fold]
            spread = h[-1, -1] - h[0, -1] ** 2 / h[0, 0] if h[0, 0] > 0 else 0.0
            if f.start[fold] is None or spread <= 0:
                continue
            for subset in _eliminate(f, fold, p, step, k or 1):
                b = f.coefficients(f.models(subset)[fold], subset)
                scores.setdefault(len(subset), []).append(1 - float(b @ h @ b) / spread)
        k = min(scores, key=lambda s: (-round(float(np.mean(scores[s])), 9), s)) if scores else k or 1
    k = max(1, p // 2) if k is None else k
    way = _eliminate(Folds(products.sum(axis=0)[None]), 0, p, step, k)
    rows = []
    for j, c in enumerate(cols):
        left = sum(1 for s in way if j in s)
        rows.append((c, len(way) - left + 1, left == len(way)))
    return df.sparkSession.createDataFrame(rows, "feature string, ranking int, selected boolean")
