"""Operator 5 against brute force over all windows of all texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import suffix_dedup as S

SCHEMA = "doc_id bigint, text string, id string, t string, spans int"


def brute(rows, length):
    data = [(r[1] or "").encode() for r in rows]
    seen = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for r, t in zip(rows, data, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        left = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        n = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((r[0], len(t), sum(gone), n, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def rows_for(seed, length):
    rnd = random.Random(seed)
    words = ["ab", "abc", "é", "the", "of", "日本", "x", "lorem"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 120))) for _ in range(30)]
    passage = " ".join(rnd.choice(words) for _ in range(60))
    for _ in range(20):
        a, b = rnd.choice(texts), rnd.choice(texts)
        i, j = sorted(rnd.randrange(len(passage) + 1) for _ in range(2))
        texts.append(a[:rnd.randrange(len(a) + 1)] + passage[i:j] + b)
    texts += [texts[0]] * 3 + ["a" * 500, "ab" * 300, "abc" * 200, "", None, "a" * length, "a" * (length + 1)]
    rows = [(i, t, "x", None, 1) for i, t in enumerate(texts)]
    return rows + [(3, texts[3], "x", None, 1), (None, texts[5], None, None, 1), (None, None, None, None, 1)]


@pytest.mark.parametrize("length,group_rows", [(40, 1000), (40, 2), (97, 3)])
def test_equals_brute_force(spark, length, group_rows):
    rows = rows_for(length + group_rows, length)
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(r) for r in S.remove_repeats(df, length=length, group_rows=group_rows).collect()), key=str)
    assert got == brute(rows, length)


def test_empty_table(spark):
    assert S.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_suffix_sort_equals_sorted():
    rnd = random.Random(5)
    data = bytes(rnd.choice(b"ab") for _ in range(4000))
    starts = np.array([rnd.randrange(3900) for _ in range(300)])
    sizes = np.array([rnd.randrange(0, 100) for _ in starts])
    group = np.array([rnd.randrange(7) for _ in starts])
    order, lcp = S.suffix_sort(np.frombuffer(data, np.uint8), starts, sizes, group)
    want, want_lcp = S._exact_sort(np.frombuffer(data, np.uint8), starts, sizes, group)
    cut = lambda k: (group[k], data[starts[k]:starts[k] + sizes[k]])
    assert [cut(k) for k in order] == [cut(k) for k in want]
    assert lcp.tolist() == want_lcp.tolist()


def test_segments_of_long_texts(monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 256)
    data = np.frombuffer(bytes(random.Random(1).choice(b"abc") for _ in range(1000)), np.uint8)
    a, r, s, n, off = S.runs_of(data, 40)
    assert int(n.sum()) == 961 and s[0] == 0 and (s[1:] == s[:-1] + n[:-1]).all()
    assert (off >= n - 1).all()
