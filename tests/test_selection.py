"""Wrapper selection against least squares per subset, nearest-neighbour information
against direct counts, whole-table permutations."""

import itertools
import math
import zlib

import numpy as np
import pytest

from quarry.functions.columns import hash_bucket
from quarry.operators import select as I
from quarry.operators import wrappers as W
from pyspark.sql import functions as F

COLS = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(240, 5)) * [1, 2, 1, 3, 1] + 100
    x[:, 4] = x[:, 0] + x[:, 1]  # determined by two others
    y = 2 * x[:, 0] - x[:, 1] + 0.3 * x[:, 2] + rng.normal(size=240)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))] + [(900, None, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, e double, y double")
    fold = {r["id"]: r["f"] for r in df.select("id", hash_bucket(42, F.col("id"), 4).alias("f")).collect()}
    return df, x, y, np.array([fold[i] for i in range(240)])


def score(x, y, fold, subset):
    out = []
    for f in range(4):
        tr, te = fold != f, fold == f
        design = np.column_stack([np.ones(len(x)), x[:, list(subset)]])
        b, *_ = np.linalg.lstsq(design[tr], y[tr], rcond=1e-9)
        out.append(1 - ((y[te] - design[te] @ b) ** 2).sum() / ((y[te] - y[te].mean()) ** 2).sum())
    return float(np.mean(out))


def selected(df):
    return {r["size"]: (r["features"], r["score"], r["selected"]) for r in df.collect()}


def test_exhaustive(data):
    df, x, y, fold = data
    got = selected(W.select_features(df, "id", COLS, "y", "efs", k=3, folds=4))
    for size in (1, 2, 3):
        best = max(score(x, y, fold, s) for s in itertools.combinations(range(5), size))
        assert got[size][1] == pytest.approx(best, abs=1e-7)
    assert sum(v[2] for v in got.values()) == 1


@pytest.mark.parametrize("method", ["sfs", "sbs", "sffs", "sbfs"])
def test_sequential(data, method):
    df, x, y, fold = data
    got = selected(W.select_features(df, "id", COLS, "y", method, k=2, folds=4))
    for size, (features, s, chosen) in got.items():
        assert len(features) == size and chosen == (size == 2)
        assert s == pytest.approx(score(x, y, fold, [COLS.index(c) for c in features]), abs=1e-7)
    if method == "sfs":
        now = []
        for size in (1, 2):
            now.append(max((j for j in range(5) if j not in now), key=lambda j: round(score(x, y, fold, now + [j]), 8)))
            assert sorted(COLS[j] for j in now) == got[size][0]
    if method in ("sffs", "sbfs"):  # never worse than without floating
        plain = selected(W.select_features(df, "id", COLS, "y", method.replace("f", "", 1) if method == "sbfs" else "sfs", k=2, folds=4))
        assert got[2][1] >= plain[2][1] - 1e-9


def test_sweeps_go_both_ways(data):
    df, x, y, _ = data
    f = W.Folds(W.cross_products(df, "id", COLS, "y", 4)[0])
    a = f.start[0]
    assert np.allclose(W.unsweep(W.sweep(a, 2), 2), a)
    f.models((0, 1, 2))
    f._known.pop((0, 2), None)
    f._known.pop((0,), None), f._known.pop((2,), None)
    f._known.pop((1, 2), None), f._known.pop((0, 1), None), f._known.pop((1,), None)
    assert f.score((0, 2)) == pytest.approx(W.Folds(f.held).score((0, 2)))


def test_recursive_elimination(data):
    df, x, y, _ = data
    got = {r["feature"]: (r["ranking"], r["selected"]) for r in W.recursive_elimination(df, "id", COLS[:4], "y", k=1).collect()}
    left, order = list(range(4)), []
    while len(left) > 1:
        b, *_ = np.linalg.lstsq(np.column_stack([np.ones(240), x[:, left]]), y, rcond=None)
        order.append(left.pop(int(np.abs(b[1:]).argmin())))
    assert got == {COLS[j]: (4 - order.index(j), False) if j in order else (1, True) for j in range(4)}
    kept = [r["feature"] for r in W.recursive_elimination(df, "id", COLS[:4], "y", folds=4).collect() if r["selected"]]
    assert {"a", "b"} <= set(kept)


def psi(n):
    return -0.5772156649015329 + sum(1 / k for k in range(1, n))


def information(x, y, k, discrete):
    x = np.round(x / x.std() * 1e6)
    if not discrete:
        y = np.round(y / y.std() * 1e6)
    n, parts = len(x), []
    for i in range(n):
        if discrete:
            same = np.flatnonzero((y == y[i]) & (np.arange(n) != i))
            if not len(same):
                continue
            ki = min(k, len(same))
            r = max(0, np.sort(np.abs(x[same] - x[i]))[ki - 1] - 1)
            parts.append(psi(ki) - psi(len(same) + 1) - psi(int((np.abs(x - x[i]) <= r).sum())))
        else:
            far = np.delete(np.maximum(np.abs(x - x[i]), np.abs(y - y[i])), i)
            r = max(0, np.sort(far)[k - 1] - 1)
            parts.append(psi(k) - psi(int((np.abs(x - x[i]) <= r).sum())) - psi(int((np.abs(y - y[i]) <= r).sum())))
    return max(0.0, psi(len(parts)) + float(np.mean(parts)))


@pytest.mark.parametrize("discrete", [False, True])
def test_nearest_information(spark, discrete):
    rng = np.random.default_rng(3)
    x = rng.normal(size=150)
    z = rng.integers(0, 6, 150).astype(float)
    y = (rng.integers(0, 3, 150) if discrete else x + 0.3 * rng.normal(size=150)).astype(float)
    if discrete:
        x = x + y
        y[0] = 77.0  # a label of one row
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x, z, y))], "id long, x double, z double, y double")
    got = {r["feature"]: r["mi"] for r in I.nearest_mutual_info(df, "id", ["x", "z"], "y", 3, discrete).collect()}
    keep = np.arange(150) > 0 if discrete else np.ones(150, bool)
    if not discrete:
        assert got["x"] == pytest.approx(information(x, y, 3, False)) and got["z"] == pytest.approx(information(z, y, 3, False))
        assert got["x"] > got["z"]
    else:  # scaled by all rows, then without the single label
        assert got["x"] == pytest.approx(information_discrete(x, y, 3)) and got["x"] > 0.05


def information_discrete(x, y, k):
    x = np.round(x / x.std() * 1e6)
    keep = np.array([(y == v).sum() > 1 for v in y])
    x, y = x[keep], y[keep]
    parts = []
    for i in range(len(x)):
        same = np.flatnonzero((y == y[i]) & (np.arange(len(x)) != i))
        ki = min(k, len(same))
        r = max(0, np.sort(np.abs(x[same] - x[i]))[ki - 1] - 1)
        parts.append(psi(ki) - psi(len(same) + 1) - psi(int((np.abs(x - x[i]) <= r).sum())))
    return max(0.0, psi(len(x)) + float(np.mean(parts)))


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 4097])
def test_permuted_ranks_are_a_bijection(n):
    keys = I.round_keys(1, 0)
    out = I.permuted_ranks(np.arange(n), n, keys)
    assert sorted(out) == list(range(n))
    if n > 1000:
        assert (np.abs(out - np.arange(n)) > 256).mean() > 0.7
        assert not np.array_equal(out, I.permuted_ranks(np.arange(n), n, I.round_keys(1, 1)))


def test_columns_move_over_the_whole_table(spark):
    df = spark.range(3000).select("id", F.col("id").cast("double").alias("v"), F.when(F.col("id") % 10 > 0, F.col("id")).alias("w"))
    rows = I.permute_columns(df, "id", ["v", "w"], 5).collect()
    assert sorted(r["shadow_v"] for r in rows) == [float(i) for i in range(3000)]
    assert sum(r["shadow_w"] is None for r in rows) == 300
    assert sum(abs(r["shadow_v"] - r["v"]) > 256 for r in rows) > 2000
    again = {r["id"]: r["shadow_v"] for r in I.permute_columns(df.repartition(5), "id", ["v", "w"], 5).collect()}
    assert again == {r["id"]: r["shadow_v"] for r in rows}
    assert I.permute_columns(df.where("id < 0"), "id", ["v"], 1).collect() == []


def _ranking(monkeypatch):
    from quarry.functions import stats

    calls, rank = [], stats.global_rank
    monkeypatch.setattr(stats, "global_rank", lambda df, *a, **k: calls.append(df.columns) or rank(df, *a, **k))
    return calls


def test_permutation_importance_ranks_once(spark, monkeypatch):
    rnd = np.random.default_rng(2)
    a, b = rnd.normal(size=(2, 400))
    y = 3 * a + 0.2 * b + 0.1 * rnd.normal(size=400)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(zip(a, b, y))], "id bigint, a double, b double, y double")
    want = {}
    m = np.linalg.lstsq(np.column_stack([np.ones(400), a, b]), y, rcond=None)[0]
    r2 = lambda x: 1 - ((y - np.column_stack([np.ones(400), *x]) @ m) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    for i, c in enumerate("ab"):
        drops = []
        for r in range(2):
            to = I.permuted_ranks(np.arange(400), 400, I.round_keys(42 + 31 * r + i, 0))
            x = [a.copy(), b.copy()]
            x[i][to] = [a, b][i]
            drops.append(r2([a, b]) - r2(x))
        want[c] = (np.mean(drops), np.std(drops))
    calls = _ranking(monkeypatch)
    got = I.permutation_importance(df, "id", ["a", "b"], "y", n_repeats=2, k=1).collect()
    assert len(calls) == 1
    assert [(r["feature"], r["rank"], r["selected"]) for r in got] == [("a", 1, True), ("b", 2, False)]
    assert all(np.allclose((r["importance"], r["std"]), want[r["feature"]], atol=1e-9) for r in got)


def test_boruta_ranks_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 17), float(i * 7919 % 101), 5.0 * (i % 17)) for i in range(300)], "id bigint, a double, b double, y double")
    calls = _ranking(monkeypatch)
    got = {r["feature"]: r["hits"] for r in I.boruta(df, "id", ["a", "b"], "y", n_iter=2).collect()}
    assert len(calls) == 1 and got["a"] == 2
