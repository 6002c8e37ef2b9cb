"""The set join against brute force on repeated rows and copies, and what it lets
reach the pair joins."""

import random

import pytest

from quarry.operators import similarity as S


def frame(spark, rows, kind="bigint"):
    return spark.createDataFrame(rows, f"id {kind}, toks array<bigint>")


def brute(q, d, t, self_join, strict=True):
    out = []
    for i, a in q:
        for j, b in d:
            if i is None or j is None or (self_join and (i >= j if strict else i == j)):
                continue
            both, all_ = len(set(a) & set(b)), len(set(a) | set(b))
            if both and both / all_ >= t:
                out.append((i, j, both, len(a), len(b), round(both / all_, 9)))
    return sorted(out)


def found(df):
    return sorted((r["qid"], r["did"], r["inter"], r["qn"], r["dn"], round(r["sim"], 9)) for r in df.collect())


def rows(seed, n=60):
    rnd, out = random.Random(seed), [(0, []), (None, [1, 2, 3])]
    while len(out) < n:
        t = {rnd.randint(0, 4) for _ in range(3)} | {rnd.randint(10, 200) for _ in range(rnd.randint(0, 9))}
        t |= set(range(300, 300 + rnd.choice((0, 0, 7, 20))))
        out += [(len(out) + k, sorted(t | ({rnd.randint(500, 900)} if k else set()))) for k in range(rnd.randint(1, 3))]
        if rnd.random() < 0.3:  # another id, then the same row again
            out += [(len(out) + 5000, sorted(t))]
            out += [out[-1]]
    return out


@pytest.mark.parametrize("t", [0.3, 0.7, 1.0])
def test_repeated_rows_and_copies(spark, t):
    x = rows(int(t * 10))
    assert found(S.set_join(frame(spark, x), None, "id", "id", threshold=t, self_join=True)) == brute(x, x, t, True)


def test_both_orders_and_two_tables(spark):
    x, y = rows(1), rows(2)
    assert found(S.set_join(frame(spark, x), None, "id", "id", threshold=0.4, self_join=True, strict_upper=False)) == \
        brute(x, x, 0.4, True, False)
    assert found(S.set_join(frame(spark, x), frame(spark, y), "id", "id", threshold=0.4)) == brute(x, y, 0.4, False)


def test_without_threshold(spark):
    x, y = [(i, t) for i, (_, t) in enumerate(rows(3))], [(i, t) for i, (_, t) in enumerate(rows(4))]
    assert found(S.set_join(frame(spark, x), None, "id", "id", self_join=True)) == brute(x, x, 0, True)
    assert found(S.set_join(frame(spark, x), frame(spark, y), "id", "id")) == brute(x, y, 0, False)


def test_common_tokens_go_as_one(spark):
    """Tokens of one row are dropped, the 300 in every row are one of weight 300."""
    x = S._rows(frame(spark, [(i, [*range(300), *range(1000 * i + 1000, 1000 * i + 1200)]) for i in range(8)]), "id", "toks")
    got = S._token_classes(x, None).collect()
    assert len(got) == 8 and {r["w"] for r in got} == {300}


def test_best_match_orders_common_tokens_only(spark, monkeypatch):
    """Tokens that one set or one side only has do not reach the joins."""
    held, ordered = [], S._ordered

    def watched(nodes, freq):
        out = ordered(nodes, freq)
        held.append(max(len(r["s"]) for r in out.collect()))
        return out

    monkeypatch.setattr(S, "_ordered", watched)
    d = frame(spark, [(i, [1, 2 + i % 2, *range(100 * i + 100, 100 * i + 180)]) for i in range(6)])
    q = frame(spark, [(0, [1, 2, 5000, 5001])])
    assert found_best(S.best_match(q, d, "id", "id")) == [(0, 0, round(2 / 84, 9))]
    assert found_best(S.best_match(d, d, "id", "id", self_join=True))[0] == (0, 2, round(2 / 162, 9))
    assert held == [2, 2, 2]


def found_best(df):
    return sorted((r["qid"], r["did"], round(r["sim"], 9)) for r in df.collect())


def test_rows_that_reach_no_other_are_not_written(spark):
    # 100 of 400 tokens are shared by all; three rows differ in 40 tokens only, two are equal.
    x = [(i, [*range(100), *range(1000 * i + 1000, 1000 * i + 1300)]) for i in range(10)]
    near = [(20 + i, [*range(50_000, 50_360), *range(60_000 + 40 * i, 60_040 + 40 * i)]) for i in range(3)]
    x += near + [(30, [*range(70_000, 70_200)]), (31, [*range(70_000, 70_200)])]
    for t, ids in ((0.7, [20, 21, 22, 30, 31]), (0.2, [i for i, _ in x])):
        assert sorted(r["id"] for r in S._rows(frame(spark, x), "id", "toks", True, t).collect()) == ids
        got = S.set_join(frame(spark, x), None, "id", "id", threshold=t, self_join=True)
        want = [(i, j) for i, a in x for j, b in x if i < j and len({*a} & {*b}) / len({*a} | {*b}) >= t]
        assert sorted((r["qid"], r["did"]) for r in got.collect()) == sorted(want)


def test_repeated_and_null_tokens_pass_the_floor(spark):
    x = [(1, [1, 1, 1, 2]), (2, [1, 1, 1, 2]), (3, [None]), (4, [None]), (5, None), (6, [])]
    got = S.set_join(frame(spark, x), None, "id", "id", threshold=0.7, self_join=True)
    assert sorted((r["qid"], r["did"], r["sim"]) for r in got.collect()) == [(1, 2, 1.0), (3, 4, 1.0)]


def test_characters_are_taken_once_a_row(spark):
    text = {1: "abc\U0001f600", 2: "abd", 3: "abcé", 4: "", 5: None, 6: "ab\x00"}
    x = [(i, t, [*range(9), 100 + i], float(i)) for i, t in text.items()]
    df = spark.createDataFrame(x, "id bigint, text string, toks array<bigint>, act double")
    out = S.matched_pairs(df, "id", "text", "act")

    def label(a, b):
        if a is None or b is None:
            return "similar"
        more, less = "".join(sorted({*b} - {*a})), "".join(sorted({*a} - {*b}))
        return f"-{less}+{more}" if more and less else f"+{more}" if more else f"-{less}" if less else "similar"

    assert {(r["id_i"], r["id_j"]): (r["transformation"], r["delta"]) for r in out.collect()} == {
        (i, j): (label(a, b), float(j - i)) for i, a in text.items() for j, b in text.items() if i < j}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    joined = plan[:plan.index("Join")]
    assert "regexp_extract_all" not in plan and "run(" not in joined


def test_map_of_shared_tokens_grows_with_them(spark, monkeypatch):
    monkeypatch.setattr(S, "_MAP_BITS", 13)
    x = [(i, [*range(3000), *range(10_000 * i + 10_000, 10_000 * i + 12_000)]) for i in range(2)]
    bits, held = S._shared_map(frame(spark, x), "toks")
    assert bits == 15 and len(held) == 1 << 12
    kept = S._rows(frame(spark, x), "id", "toks", True).collect()
    assert all(set(range(3000)) <= set(r["toks"]) and len(r["toks"]) < 3600 for r in kept)


def test_codes_are_sent_in_few_bytes():
    import zlib

    import numpy as np

    rnd = np.random.default_rng(3)
    code = np.sort(rnd.integers(0, 1 << 27, 2048))
    sent = S._gaps(code)
    assert (S._from_gaps(sent) == code).all() and len(S._from_gaps(S._gaps(code[:0]))) == 0
    assert len(zlib.compress(sent, 1)) < 2.6 * len(code)


def test_common_tokens_are_shuffled_once(spark):
    x = S._rows(frame(spark, [(i, [*range(30), 100 + i]) for i in range(8)]), "id", "toks")
    out = S._token_classes(x, None)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert final.count("Generate explode") == 1
