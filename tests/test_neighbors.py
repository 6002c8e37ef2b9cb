"""Nearest-neighbour and radius joins against brute force, with nulls, copies and
ties; the number of distances grows with the rows, not with their square."""

import numpy as np
import pytest

from quarry.operators import domain as J
from quarry.operators import model, preprocess
from quarry.operators import neighbors as N


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(N, "CELL_POINTS", 16)
    monkeypatch.setattr(N, "BLOCK_POINTS", 20)


def frame(spark, v, name=lambda i: i, kind="bigint"):
    rows = [(name(i), [None if np.isnan(x) else float(x) for x in r], 1, "x") for i, r in enumerate(v)]
    return spark.createDataFrame(rows, f"id {kind}, v array<double>, score int, rank string")


def brute(q, d, k, metric, skip_self=False):
    out = []
    for i, a in enumerate(q):
        found = []
        for j, b in enumerate(d):
            if skip_self and i == j:
                continue
            if metric == "cosine":
                size = np.linalg.norm(a) * np.linalg.norm(b)
                s = -round(float(a @ b / size) if size > 0 else 0.0, 9)
            else:
                both = ~np.isnan(a) & ~np.isnan(b)
                if not both.any():
                    continue
                diff, up = (a - b)[both], len(a) / both.sum()
                s = round(float(np.sqrt((diff ** 2).sum() * up) if metric == "euclidean" else np.abs(diff).sum() * up), 9)
            found.append((s, j))
        out += [(i, j, round(-s if metric == "cosine" else s, 7) + 0.0, r + 1) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def rows(df):
    return sorted((r["qid"], r["did"], round(r["score"], 7) + 0.0, r["rank"]) for r in df.collect())


@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "cosine"])
def test_topk_equals_brute_force(spark, small_cells, metric):
    rng = np.random.default_rng(1)
    v = np.round(rng.normal(size=(160, 3)) * 2) / 2
    v[:40], v[41] = v[0], 0
    f = frame(spark, v)
    assert rows(N.dense_topk(f, f, "id", "id", "v", 4, metric, exclude_self=True)) == brute(v, v, 4, metric, True)
    q = rng.normal(size=(30, 3))
    assert rows(N.dense_topk(frame(spark, q), f, "id", "id", "v", 200, metric)) == brute(q, v, 200, metric)


@pytest.mark.parametrize("pairs", [64, 1])
def test_null_features_lose_no_row(spark, small_cells, monkeypatch, pairs):
    monkeypatch.setattr(N, "PATTERN_PAIRS", pairs)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(90, 2))
    v[rng.random(v.shape) < 0.15] = np.nan
    v[3] = np.nan
    f = frame(spark, v)
    got = rows(N.dense_topk(f, f, "id", "id", "v", 3, exclude_self=True))
    assert got == brute(v, v, 3, "euclidean", True)
    assert {r[0] for r in got} == set(range(90)) - {i for i in range(90) if np.isnan(v[i]).all()}


def test_string_ids_and_empty_tables(spark, small_cells):
    v = np.random.default_rng(3).normal(size=(50, 2))
    f = frame(spark, v, lambda i: f"r{i:03d}", "string")
    got = [(int(a[1:]), int(b[1:]), s, r) for a, b, s, r in rows(N.dense_topk(f, f, "id", "id", "v", 2))]
    assert got == brute(v, v, 2, "euclidean")
    none = f.where("1 = 0")
    assert N.dense_topk(none, f, "id", "id", "v", 2).collect() == []
    assert N.dense_topk(f, none, "id", "id", "v", 2).columns == ["qid", "did", "score", "rank"]
    assert N.dense_radius(none, f, "id", "id", "v", 1.0).collect() == []
    assert N.dbscan(none, "id", "v").collect() == []


def seen(spark, v, k=5):
    acc = spark.sparkContext.accumulator(0)
    f = frame(spark, v)
    N.dense_topk(f, f, "id", "id", "v", k, exclude_self=True, seen=acc).write.format("noop").mode("overwrite").save()
    return acc.value


def test_distances_grow_with_the_rows(spark, monkeypatch):
    """Twice the rows take some twice the distances; half of them lie in one dense spot."""
    monkeypatch.setattr(N, "CELL_POINTS", 32)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(4000, 2))
    v[::2] *= 1e-4
    less, more = seen(spark, v[:2000]), seen(spark, v)
    assert more < 2.6 * less and more < 4000 * 4000 / 10


def test_copies_cost_one_point(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_POINTS", 32)
    v = np.random.default_rng(5).normal(size=(300, 2))
    copies = np.concatenate([v, np.repeat(v[:1], 2000, axis=0)])
    assert seen(spark, copies) <= 1.1 * seen(spark, v)


def test_radius_equals_brute_force(spark, small_cells):
    rng = np.random.default_rng(6)
    v = np.round(rng.normal(size=(120, 2)), 1)
    v[:20] = v[0]
    f = frame(spark, v)
    far = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), 9)
    want = sorted((i, j) for i in range(120) for j in range(120) if i != j and far[i, j] <= 0.3)
    assert sorted((r["qid"], r["did"]) for r in N.dense_radius(f, f, "id", "id", "v", 0.3, True).collect()) == want


def clusters(v, eps, least):
    far = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), 9) <= eps
    core = far.sum(axis=1) >= least
    label = {i: i for i in range(len(v)) if core[i]}
    while True:
        new = {i: min(label[j] for j in label if far[i, j]) for i in label}
        if new == label:
            break
        label = new
    return {i: label.get(i, min((label[j] for j in label if far[i, j]), default=-1)) for i in range(len(v))}


@pytest.mark.parametrize("eps,least", [(0.2, 5), (0.05, 3), (2.0, 5), (0.2, 400)])
def test_dbscan_equals_brute_force(spark, small_cells, eps, least):
    rng = np.random.default_rng(7)
    v = np.concatenate([rng.normal(size=(150, 2)), np.linspace([3, 3], [9, 3], 60), np.repeat([[5.0, -5.0]], 6, axis=0)])
    got = {r["id"]: r["cluster"] for r in model.cluster(frame(spark, v), "id", "v", "dbscan", eps=eps, min_samples=least).collect()}
    assert got == clusters(v, eps, least)


def test_rows_without_features_have_defined_values(spark):
    v = [(i, float(i % 7), float(i % 5), float(i)) for i in range(30)] + [(30, None, 1.0, 2.0), (31, None, None, None)]
    df = spark.createDataFrame(v, "id long, a double, b double, t double")
    test = df.where("id >= 28")
    for out in (J.distance_ad(df, test, "id", ["a", "b"]), J.knn_ad_v2(df, test, "id", ["a", "b"]), J.lof_ad(df, test, "id", ["a", "b"])):
        got = {r["id"]: r for r in out.collect()}
        assert set(got) == {28, 29, 30, 31}
        assert got[30]["distance"] is not None
        assert (got[31]["distance"], got[31]["in_domain"], got[31]["confidence"]) == (None, False, 0.0)
    filled = {r["id"]: r["t"] for r in preprocess.knn_impute(df, "id", "t", ["a", "b"]).collect()}
    assert filled[31] == pytest.approx((sum(range(30)) + 2.0) / 31) and filled[5] == 5.0


def test_clustering_is_named(spark):
    with pytest.raises(ValueError):
        model.cluster(frame(spark, np.zeros((3, 2))), "id", "v", "auto")


def test_a_threshold_of_zero_is_no_error(spark):
    """Training rows with more than k copies each: their mean distance is 0."""
    train = spark.createDataFrame([(i, float(i % 3), float(i % 2)) for i in range(60)], "id bigint, a double, b double")
    test = spark.createDataFrame([(1, 2.0, 1.0), (2, 5.0, 9.0), (3, None, None)], "id bigint, a double, b double")
    got = {r["id"]: r for r in J.distance_ad(train, test, "id", ["a", "b"]).collect()}
    assert {r["threshold"] for r in got.values()} == {0.0}
    assert [(got[i]["in_domain"], got[i]["confidence"]) for i in (1, 2, 3)] == [(True, 1.0), (False, 0.0), (False, 0.0)]
    voted = {r["id"]: r["votes"] for r in J.vote([J.distance_ad(train, test, "id", ["a", "b"])], "id").collect()}
    assert voted == {1: 1, 2: 0, 3: 0}


def _wide(spark, n=700, p=24, shift=1000.0):
    """Vectors without structure, far from 0, in which products cancel; some nearly equal."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(n, p)) + shift
    v[1], v[2], v[3] = v[0], v[0] + 1e-7, v[0] + 3e-9
    return v, frame(spark, v)


def test_wide_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_POINTS", 300)
    monkeypatch.setattr(N, "_TABLE", 10_000)
    v, f = _wide(spark)
    assert rows(N.dense_topk(f, f, "id", "id", "v", 3, "euclidean", exclude_self=True)) == brute(v, v, 3, "euclidean", True)
    eps = 4.2
    far = np.round(np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)), 9)
    got = sorted((r["qid"], r["did"]) for r in N.dense_radius(f, f, "id", "id", "v", eps).collect())
    assert got == [(i, j) for i in range(len(v)) for j in range(len(v)) if far[i, j] <= eps]
    close = far <= eps
    core = close.sum(axis=1) >= 5
    label = {i: i for i in np.flatnonzero(core)}
    while True:
        new = {i: min(label[j] for j in np.flatnonzero(close[i] & core)) for i in label}
        if new == label:
            break
        label = new
    want = {i: label.get(i, min((label[j] for j in np.flatnonzero(close[i] & core)), default=None)) for i in range(len(v))}
    assert {r["id"]: r["cluster"] for r in N.dbscan(f, "id", "v", eps, 5).collect()} == want


def test_wide_vectors_are_sent_to_few_cells(spark):
    """Vectors of many features leave no cell out: a row is sent to each of them."""
    _, f = _wide(spark, 3000, 32, 0.0)
    pts = N.points(N.vectors(f, "id", "v"), 1).select("rep", "v")
    cells = N.Cells(pts, "euclidean")
    asked = cells.deal(pts, True)
    sent, _ = cells.others(asked, None, 100.0)
    assert sent.count() <= 3000
