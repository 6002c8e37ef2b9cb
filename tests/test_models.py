"""Learners against direct forms: alignment, quantile regression, non-negative factors,
principal components, Bayesian ridge imputation."""

import itertools
import random

import numpy as np
import pytest

from quarry.operators import model as J
from quarry.operators import preprocess as G
from quarry.operators import similarity as S


def align(a, b, match=1, mismatch=-1, gap=-2):
    """Cell by cell, walked back diagonal before up before left."""
    t = [[(i + j) * gap if not i or not j else None for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        t[i][j] = max(t[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), t[i - 1][j] + gap, t[i][j - 1] + gap)
    i, j, same, n = len(a), len(b), 0, 0
    while i or j:
        if i and j and t[i][j] == t[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            same += a[i - 1] == b[j - 1]
            i, j = i - 1, j - 1
        elif i and t[i][j] == t[i - 1][j] + gap:
            i -= 1
        else:
            j -= 1
        n += 1
    return t[-1][-1], same / n if n else 0.0, n


def test_alignment_equals_cell_by_cell(spark, monkeypatch):
    rnd = random.Random(1)
    pairs = [("".join(rnd.choices("ABé\U0001F600", k=rnd.randint(0, 12))), "".join(rnd.choices("ABé\U0001F600", k=rnd.randint(0, 12)))) for _ in range(300)]
    pairs += [("", ""), ("A", ""), ("", "AB"), ("GATTACA", "GCATGCU")]
    for scores in ((1, -1, -2), (2, -1, -1), (1, 0, 0)):
        got = list(zip(*(v.tolist() for v in S.align_batch(*zip(*pairs), *scores))))
        assert got == [pytest.approx(align(a, b, *scores)) for a, b in pairs]
    monkeypatch.setattr(S, "_CELLS", 200)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)] + [(999, None, "AB")], "id int, a string, b string")
    got = {r["id"]: tuple(r["x"]) for r in df.select("id", S.alignment_udf()("a", "b").alias("x")).collect()}
    assert got == {**{i: pytest.approx(align(a, b)) for i, (a, b) in enumerate(pairs)}, 999: (-4, 0.0, 2)}


def pinball(y, p, q):
    return np.where(y > p, q * (y - p), (q - 1) * (y - p)).sum()


@pytest.mark.parametrize("skew", [False, True])
def test_quantile_regression(spark, skew):
    rng = np.random.default_rng(2)
    x = rng.normal(size=80) * 3 + 50
    y = 2 * x + (rng.exponential(5, 80) if skew else rng.normal(size=80) * 4)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(900, None, 1.0)], "id int, x double, y double")
    b, left = J.quantile_regression(df, ["x"], "y", [0.1, 0.5, 0.9])
    for t, q in enumerate((0.1, 0.5, 0.9)):
        # The best line goes through two of the points.
        best = min(pinball(y, y[i] + (y[j] - y[i]) / (x[j] - x[i]) * (x - x[i]), q) for i, j in itertools.combinations(range(80), 2))
        assert pinball(y, b[t, 0] + b[t, 1] * x, q) <= best * 1.002
    assert (left <= 1e-3).all()
    out = {r["id"]: r for r in J.quantile_interval(df, "id", ["x"], "y", alpha=0.2).collect()}
    inside = sum(out[i]["lower"] <= y[i] <= out[i]["upper"] for i in range(80))
    assert 60 <= inside <= 70 and out[900]["lower"] is None


def test_nonnegative_factors(spark):
    rng = np.random.default_rng(3)
    x = rng.random((60, 3)) @ rng.random((3, 8))
    df = spark.createDataFrame([(f"r{i}", [float(v) for v in r]) for i, r in enumerate(x)], "id string, x array<double>")
    w, h, losses = J.nmf(df, "id", "x", rank=3, max_iter=30, tol=0.0)
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:]))
    assert losses[-1] < 0.01 * (x ** 2).sum() and (h >= 0).all()
    rows = {r["id"]: np.array(r["w"]) for r in w.collect()}
    assert all((v >= 0).all() for v in rows.values())
    assert sum(((x[i] - rows[f"r{i}"] @ h) ** 2).sum() for i in range(60)) == pytest.approx(losses[-1], abs=1e-6)
    with pytest.raises(ValueError):
        J.nmf(df.selectExpr("id", "transform(x, v -> -v) AS x"), "id", "x")
    assert J.nmf(df.where("1 = 0"), "id", "x")[2] == []


def test_components_there_and_back(spark):
    x = np.random.default_rng(4).normal(size=(50, 4)) @ np.diag([5, 2, 1, 0.1]) + 3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, v array<double>")
    mean, comps, share = J.pca_fit(df, "v")
    values = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert share == pytest.approx(values / values.sum())
    back = {r["id"]: r["restored"] for r in J.pca_inverse(J.pca_transform(df, "v", mean, comps), "pc", mean, comps).collect()}
    assert all(back[i] == pytest.approx(x[i]) for i in range(50))
    near = J.pca_inverse(J.pca_transform(df, "v", mean, comps[:2]), "pc", mean, comps[:2])
    lost = sum(((np.array(r["restored"]) - x[r["id"]]) ** 2).sum() for r in near.collect())
    assert lost == pytest.approx(values[2:].sum() * 49)


def ridge(x, y):
    """Evidence maximisation with plain inverses."""
    xm, ym = x.mean(axis=0), y.mean()
    x, y = x - xm, y - ym
    noise, weight, coef = 1 / (y.var() + np.finfo(float).eps), 1.0, np.zeros(x.shape[1])
    for i in range(300):
        old = coef
        s = np.linalg.inv(weight * np.eye(x.shape[1]) + noise * x.T @ x)
        coef = noise * s @ x.T @ y
        if i and np.abs(old - coef).sum() < 1e-3:
            break
        known = x.shape[1] - weight * np.trace(s)
        weight = (known + 2e-6) / ((coef ** 2).sum() + 2e-6)
        noise = (len(y) - known + 2e-6) / (((y - x @ coef) ** 2).sum() + 2e-6)
    return coef, ym - coef @ xm


def chained(x, rounds=10, tol=1e-3):
    holes, out = np.isnan(x), np.where(np.isnan(x), np.nanmean(x, axis=0), x)
    order = sorted((c for c in range(x.shape[1]) if holes[:, c].any()), key=lambda c: (holes[:, c].sum(), c))
    for _ in range(rounds):
        old = out.copy()
        for c in order:
            rest = [k for k in range(x.shape[1]) if k != c]
            coef, start = ridge(out[~holes[:, c]][:, rest], out[~holes[:, c], c])
            out[holes[:, c], c] = out[holes[:, c]][:, rest] @ coef + start
        if np.abs(out - old).max() < tol * np.nanmax(np.abs(x)):
            break
    return out


def test_chained_imputer(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3)) @ rng.normal(size=(3, 4)) + rng.normal(size=(120, 4)) * 0.2 + 5
    x[rng.random(x.shape) < 0.1] = np.nan
    df = spark.createDataFrame([(i, *(None if np.isnan(v) else float(v) for v in r)) for i, r in enumerate(x)], "id int, a double, b double, c double, d double")
    got = {r["id"]: r for r in G.iterative_impute(df, ["a", "b", "c", "d"]).collect()}
    want = chained(x)
    for i in range(120):
        assert [got[i][c] for c in "abcd"] == pytest.approx(want[i].tolist(), abs=1e-6)


def test_chained_imputer_edges(spark):
    df = spark.createDataFrame([(1, None, 2.0), (2, None, None), (3, None, 4.0)], "id int, a double, b double")
    assert sorted((r["id"], r["a"], r["b"]) for r in G.iterative_impute(df, ["a", "b"]).collect()) == [(1, None, 2.0), (2, None, 3.0), (3, None, 4.0)]
    assert G.iterative_impute(df.where("id = 1"), ["b"]).first()["b"] == 2.0


def test_presets(spark):
    rows = [(i, float(i % 9) if i % 4 else None, "ab"[i % 2] if i % 5 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, x double, k string")
    types = {"x": "continuous", "k": "categorical"}
    for name in G.PRESETS:
        out = G.smart_preprocess(df, types, G.preset(name), keep=["id"])
        assert out.count() == 40 and out.where("x is null").count() == 0
        assert ("k_ord" in out.columns) == (G.PRESETS[name]["encode"] == "ordinal")
    low = G.smart_preprocess(df, types, G.preset("minimal"), keep=["id"]).where("id % 4 = 0")
    assert {r["x"] for r in low.collect()} == {0.0}
    assert G.preset("minimal", impute="mean")["impute"] == "mean" and G.preset("no such") == G.PRESETS["default"]


def test_many_categories(spark):
    df = spark.range(15_000).selectExpr("id", "cast(id as string) AS k")
    out = G.ordinal_encode(df, df.where("id > 0"), "k")
    assert out.agg({"k_ord": "max"}).first()[0] == 14_998 and out.where("k_ord = -1").count() == 1
