"""Operator 10 against brute force over all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import jaccard_join as J
from quarry.llm.jaccard_sets import parts, sketches

SCHEMA = "doc_id bigint, text string, s bigint, id string, q int"


def shingles(text, size):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent):
    sets = [shingles(r[1], size) for r in rows]
    part = list(range(len(rows)))

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and 100 * len(x & y) >= percent * len(x | y):
                part[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(r[0], low.get(find(i), r[0]))
    return [(r[0], len(sets[i]), low.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)]


def rows_for(seed):
    rnd = random.Random(seed)
    vocab = ["Ab", "abc", "é", "É", "the", "of", "日本", "x y", "lorem", "z"] + [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = [rnd.choice(vocab) for _ in range(rnd.randrange(1, 90))]
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(0, 8)):
            b = list(base)
            for _ in range(rnd.randrange(0, 4)):
                b[rnd.randrange(len(b))] = rnd.choice(vocab)
            texts.append(rnd.choice([" ", "\n", "\t  "]).join(b))
    line = " ".join(rnd.choice(vocab) for _ in range(12))
    texts += [f"{line} {rnd.choice(vocab)} {i}" for i in range(30)] + ["", None, " \n", "one", "ONE", "two words", "Two  Words"]
    rows = [(i * 3 % 1009, t, 1, "x", None) for i, t in enumerate(texts)]
    return rows + [rows[0], rows[0], (None, texts[0], 1, None, 1), (None, "no one else says this", 1, None, 1), (None, None, 1, None, 1)]


@pytest.mark.parametrize("seed,size,percent", [(1, 4, 85), (2, 4, 85), (3, 2, 60), (4, 5, 80)])
def test_equals_brute_force(spark, seed, size, percent):
    rows = rows_for(seed)
    got = J.jaccard_components(spark.createDataFrame(rows, SCHEMA), size=size, percent=percent).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, size, percent), key=str)


def test_groups_over_several_batches(spark):
    rows = rows_for(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = J.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows, 4, 85), key=str)


def test_one_of_each_keeps_one(spark):
    rows = rows_for(5)
    df = spark.createDataFrame(rows, SCHEMA)
    got = J.one_of_each(df)
    assert got.columns == df.columns
    want = brute(rows, 5, 80)
    groups = {(c if n else None) for _, n, c in want if n}
    ids = [r["doc_id"] for r in got.collect() if shingles(r["text"], 5)]
    assert len(ids) == len(set(ids)) and set(ids) == groups


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert J.jaccard_components(df).collect() == []
    assert J.one_of_each(df).collect() == []


def test_near_copies_cost_a_pair_each(spark):
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join([*base[:i % 100], f"e{i}", *base[i % 100 + 1:]]), 1, "x", 1) for i in range(300)]
    got = J.jaccard_components(spark.createDataFrame(rows, SCHEMA), percent=80).collect()
    assert {r["component_id"] for r in got} == {0}


def tries(spark, monkeypatch, n):
    """Pairs that are verified, and those that link, among near copies of a text."""
    rnd = np.random.default_rng(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rnd.choice(120, int(rnd.integers(2, 4)), replace=False):
            w[at] = f"e{i}.{at}"
        rows.append((i, " ".join(w), 1, "x", 1))
    tried, linked = [], []
    verify = J._verify

    def counted(*args):
        out = verify(*args)
        tried.append(args[-1][-1].count() // 2)
        linked.append(out.count())
        return out

    monkeypatch.setattr(J, "_verify", counted)
    got = J.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    monkeypatch.setattr(J, "_verify", verify)
    sets = [shingles(r[1], 4) for r in rows]
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label] if a != b else label
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(label))
    return sum(tried), sum(linked)


def test_pairs_of_a_large_group_are_nearly_all_links(spark, monkeypatch):
    less, links = tries(spark, monkeypatch, 250)
    more, links2 = tries(spark, monkeypatch, 500)
    assert less <= 1.5 * links + 2 * 250 and more <= 1.5 * links2 + 2 * 500


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(5)
    for n, apart in [(20, 3), (300, 40), (2000, 300), (60_000, 9_000)]:
        x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
        y = np.concatenate([x[apart:], rng.integers(0, 1 << 63, apart // 2, dtype=np.uint64)])
        a, b = (sketches(np.frombuffer(parts(np.unique(s)), np.uint8).reshape(1, -1)) for s in (x, y))
        assert a.shape == (1, len(J.SKETCH))
        assert int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= len(np.setxor1d(x, y))


def test_batches_are_short_inside_only(spark):
    """Texts go to Python some MB at a time; the session's setting comes back."""
    from quarry.llm.common import short_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    seen = spark.range(0, 5000, 1, 1).mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in it), "n long")
    with short_batches(spark, 700):
        assert max(r["n"] for r in seen.collect()) <= 700
    assert spark.conf.get(key) == old
    with pytest.raises(ZeroDivisionError), short_batches(spark):
        raise ZeroDivisionError
    assert spark.conf.get(key) == old
