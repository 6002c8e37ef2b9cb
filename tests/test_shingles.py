"""Shingle ids against a plain count, and that no n-gram is hashed by a JVM expression."""

from hashlib import md5

import pytest

from quarry.operators import similarity as S

TEXTS = ["", " \t\r\n", "one", "One two", "one  two\tTHREE", "a b c a b c a b c", "x y z w v İ ÉtÉ \U0001f600 q", "\n lead and trail \n", None]


def brute(t, n):
    if t is None:
        return None
    w = [x for x in t.lower().replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if x]
    grams = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    return sorted({int(md5(g.encode()).hexdigest()[:15], 16) for g in grams})


@pytest.mark.parametrize("n", [1, 2, 3])
def test_shingles(spark, capsys, n):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", "t", S.shingles("t", n).alias("s"))
    for r in df.collect():
        assert r["s"] == brute(r["t"], n), r["t"]
    df.explain()
    assert "md5" not in capsys.readouterr().out
    assert spark.createDataFrame([], "t string").select(S.shingles("t", n)).collect() == []
