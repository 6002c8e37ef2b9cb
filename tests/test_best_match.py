"""Best matches without a threshold against brute force; a token in every set
leaves the candidates linear."""

import random

import pytest

from quarry.operators import similarity as S


def frame(spark, sets, name=lambda i: i, kind="bigint"):
    return spark.createDataFrame([(name(i), list(t), "x") for i, t in enumerate(sets)], f"id {kind}, toks array<bigint>, sim string")


def sim(a, b, metric):
    both = len(a & b)
    return {"tanimoto": both / max(1, len(a | b)), "dice": 2 * both / max(1, len(a) + len(b)),
            "cosine": both / max(1, len(a) * len(b)) ** 0.5}[metric]


def brute(q, d, metric, skip_self):
    out = {}
    for i, a in enumerate(q):
        best = max(((sim(set(a), set(b), metric), -j) for j, b in enumerate(d) if not (skip_self and i == j)), default=(0, 0))
        if best[0] > 0:
            out[i] = (-best[1], round(best[0], 9))
    return out


def found(df):
    return {r["qid"]: (r["did"], round(r["sim"], 9)) for r in df.collect()}


def sets(seed, n=120):
    rnd = random.Random(seed)
    out = [[], []]
    while len(out) < n:
        t = {rnd.randint(0, 4) for _ in range(rnd.randint(0, 3))} | {rnd.randint(10, 400) for _ in range(rnd.randint(0, 12))}
        out.append(sorted(t))
        if rnd.random() < 0.3 and t:  # copies and near copies
            out.append(sorted(t))
            out.append(sorted(t | {rnd.randint(500, 900)}))
    return out


@pytest.mark.parametrize("metric", ["tanimoto", "dice", "cosine"])
@pytest.mark.parametrize("hot", [1000, 3])
def test_self_join(spark, monkeypatch, metric, hot):
    monkeypatch.setattr(S, "HOT", hot)
    x = sets(hot)
    f = frame(spark, x)
    assert found(S.best_match(f, f, "id", "id", metric=metric, self_join=True)) == brute(x, x, metric, True)


@pytest.mark.parametrize("hot", [1000, 2])
def test_two_tables(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    q, d = sets(7, 60) + [[1, 2, 3, 7000, 7001]], sets(8, 90)
    assert found(S.best_match(frame(spark, q), frame(spark, d), "id", "id")) == brute(q, d, "tanimoto", False)
    f = frame(spark, d, lambda i: f"{i:04d}", "string")
    got = {int(k): (int(v[0]), v[1]) for k, v in found(S.best_match(f, f, "id", "id", self_join=True)).items()}
    assert got == brute(d, d, "tanimoto", True)


def test_empty(spark):
    f = frame(spark, [[1], [], [2]])
    none = f.where("1 = 0")
    assert S.best_match(none, f, "id", "id").collect() == [] and S.best_match(f, none, "id", "id").collect() == []
    assert [tuple(r) for r in S.nearest_neighbor(f, "id").orderBy("id").collect()] == [(0, -1, 0.0), (1, -1, 0.0), (2, -1, 0.0)]


def candidates(spark, n):
    rnd = random.Random(n)
    x = [[0, *(1 + 10 * i + k for k in range(rnd.randint(3, 9)))] for i in range(n)]
    seen = []
    f = frame(spark, x)
    out = S.best_match(f, f, "id", "id", self_join=True, seen=seen)
    assert out.count() == n
    return sum(seen)


def test_a_token_in_every_set(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 50)
    less, more = candidates(spark, 400), candidates(spark, 800)
    assert more <= 2.2 * less and more <= 8 * 800


def test_search_is_a_scan(spark):
    x = sets(3)
    f = frame(spark, x)
    out = S.search(f.where("id = 5"), f, "id", "id", k=200)
    want = sorted(((-sim(set(x[5]), set(b), "tanimoto"), j) for j, b in enumerate(x) if set(x[5]) & set(b)))
    assert [(r["did"], round(r["sim"], 9)) for r in out.collect()] == [(j, round(-s, 9)) for s, j in want][:200]
    assert "Exchange hash" not in out._jdf.queryExecution().toString()
    assert S.search(f.where("id = -1"), f, "id", "id").collect() == []
