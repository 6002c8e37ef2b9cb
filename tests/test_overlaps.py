"""The join without a threshold makes and counts its pairs inside pairs of blocks, and
tokens of one row stay out of what is written."""

import random

import numpy as np
import pytest

from quarry.operators import similarity as S


def rows(n=70, seed=5):
    rnd = random.Random(seed)
    out = [(i, sorted({rnd.randint(0, 6) for _ in range(2)} | {rnd.randint(10, 120) for _ in range(rnd.randint(0, 9))} | {1000 + i}))
           for i in range(n)]
    return out + [(n + i, out[i][1]) for i in range(12)] + [(2 * n, []), (2 * n + 1, [])]


def frame(spark, x):
    return spark.createDataFrame(x, "id bigint, toks array<bigint>")


def brute(x):
    return sorted((i, j, len(set(a) & set(b)) / len(set(a) | set(b))) for i, a in x for j, b in x if i < j and set(a) & set(b))


def test_blocks_give_all_pairs_without_shuffling_them(spark, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK", 64)
    x = rows()
    df = S.set_join(frame(spark, x), None, "id", "id", self_join=True)
    assert sorted((r["qid"], r["did"], r["sim"]) for r in df.collect()) == brute(x)
    tree = df._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[qid" not in tree and "MapInArrow" in tree
    both = S.set_join(frame(spark, x), None, "id", "id", self_join=True, strict_upper=False)
    assert sorted((r["qid"], r["did"]) for r in both.collect()) == sorted(p for i, j, _ in brute(x) for p in ((i, j), (j, i)))


def test_sums_emit_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK", 64)
    monkeypatch.setattr(S, "set_join", None)
    x = rows()
    got = S.pairwise_stats(frame(spark, x), "id").first()
    sims = np.array([s for _, _, s in brute(x)])
    n = len(x) * (len(x) - 1) // 2 - 1
    assert got["n_pairs"] == n
    assert abs(got["mean_similarity"] - sims.sum() / n) < 1e-12
    assert abs(got["std_similarity"] - np.sqrt((sims ** 2).sum() / n - (sims.sum() / n) ** 2)) < 1e-12


def test_an_id_of_two_sets_is_joined_by_id(spark):
    x = [(1, [1, 2, 3]), (1, [3, 4]), (2, [2, 3, 9])]
    got = S.set_join(frame(spark, x), None, "id", "id", self_join=True).collect()
    assert sorted((r["inter"], r["qn"], r["dn"]) for r in got) == [(3, 2, 3), (3, 3, 3)]


def test_tokens_of_one_row_are_not_written(spark):
    x = [(i, [*range(50), *range(1000 * i + 1000, 1000 * i + 1400)]) for i in range(6)]
    kept = S._rows(frame(spark, x), "id", "toks", True).collect()
    assert all(r["n"] == 450 and set(range(50)) <= set(r["toks"]) and len(r["toks"]) < 100 for r in kept)


@pytest.mark.parametrize("metric", ["tanimoto", "dice", "cosine"])
def test_nearest_neighbors_leave_blocks_as_bests(spark, monkeypatch, metric):
    monkeypatch.setattr(S, "_BLOCK", 64)
    x = rows(90, 8)
    f = frame(spark, x)
    want = {r["qid"]: (r["did"], round(r["sim"], 12)) for r in S.best_match(f, f, "id", "id", metric=metric, self_join=True).collect()}
    monkeypatch.setattr(S, "best_match", None)
    got = {r["id"]: (r["neighbor_id"], round(r["similarity"], 12)) for r in S.nearest_neighbor(f, "id", metric=metric).collect()}
    assert got == {i: want.get(i, (-1, 0.0)) for i, _ in x}


def test_nearest_neighbors_of_odd_rows(spark):
    x = [(1, [1, 2, 3]), (1, [1, 2, 3]), (2, [2, 3, 4, 4]), (3, [None, 7]), (4, [None, 8]), (None, [1, 2]), (5, None), (6, [50]), (7, [4, 3, 2])]
    got = sorted(tuple(r) for r in S.nearest_neighbor(frame(spark, x), "id").where("id is not null").collect())
    assert got == [(1, 1, 1.0)] * 4 + [(2, 7, 1.0), (3, -1, 0.0), (4, -1, 0.0), (5, -1, 0.0), (6, -1, 0.0), (7, 2, 1.0)]
    two = S.nearest_neighbor(frame(spark, [(1, [1, 2, 3]), (1, [3, 4]), (2, [2, 3, 9])]), "id").collect()
    assert len(two) >= 3


def test_blocks_are_not_shuffled_per_block(spark, monkeypatch):
    monkeypatch.setattr(S, "_BLOCK", 64)
    df = S.set_join(frame(spark, rows()), None, "id", "id", self_join=True)
    tree = df._jdf.queryExecution().optimizedPlan().toString()
    below = tree[tree.index("MapInArrow"):].split("Union")[0].splitlines()
    assert any("Range" in line for line in below[:4])


def test_tokens_in_the_same_sets_go_as_one(spark, tmp_path):
    x = [(i, [*range(300), 1000 + i, 1001 + i]) for i in range(8)]
    entries, held = S._entries(S._rows(frame(spark, x), "id", "toks", True))
    uris = S._blocks_of(held, S._node_entries(entries.withColumn("c", S.F.lit(1))), 1)
    block = S._Block(uris[0])
    assert sorted(block.ids.to_pylist()) == [*range(8)] and len(block.tok) == 307
    assert len(np.unique(block.kind)) == 8 and len(block.node) == 8 + 7 * 2
    got = {(int(i), int(j)): int(k) for a, b, n in S._overlaps(block, block, True) for i, j, k in zip(a, b, n)}
    assert got == {(i, j): 300 + (j == i + 1) for i in range(8) for j in range(i + 1, 8)}
