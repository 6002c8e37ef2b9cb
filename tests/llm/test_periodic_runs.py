"""Operator 11 against brute force over all periods, with edge rows."""

import hashlib
import random
import re
import zlib

import pytest

from quarry.llm import periodic_runs as P

SCHEMA = "doc_id bigint, text string, runs string, best int, id string, t string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(w, shortest=24, least=3):
    """All runs, by trying every period at every place."""
    found = {}
    for q in range(1, len(w) // least + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(shortest, least * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def planted_words(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = planted_words(doc_id, words(text))
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    digest = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)]
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], *digest)


def texts():
    rnd = random.Random(5)
    out = ["", None, " \t\n", "one", "a " * 23, "a " * 24, "a\x0bb\x0cc\r" * 8, "a b c " * 8, "a b c " * 7 + "a b", "x y " * 30,
           "é é " * 12, "a " * 30 + "b " * 30 + "a b " * 20, "a a b " * 20 + "a a " * 20, "\x1c \x1d " * 20]
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    out.append(" ".join(b))
    for k in range(120):
        w = [rnd.choice("abcdef"[:rnd.randint(1, 6)]) for _ in range(rnd.randint(0, 200))]
        for _ in range(rnd.randint(0, 3)):
            at, unit = rnd.randint(0, len(w)), [rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 30))]
            w[at:at] = (unit * 12)[:rnd.randint(1, len(unit) * 6)]
        out.append(rnd.choice([" ", "\n", "  "]).join(w))
    return out


def test_equals_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "a b " * 20), (None, None), (3, "one"), (7, "a b c " * 8)]
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    got = [tuple(r) for r in P.digests(P.periodic_runs(df, rewrite=P.planted)).collect()]
    assert sorted(got, key=str) == sorted((expected(*r) for r in rows), key=str)
    assert sum(r[1] for r in got) > 50


def test_documents_do_not_meet(spark, monkeypatch):
    """The same words on both sides of a border between documents are no run."""
    df = spark.createDataFrame([(k, "a b c " * 4) for k in range(40)], "doc_id long, text string").coalesce(1)
    assert df.count() == 40
    assert all(r["runs"] == [] for r in P.periodic_runs(df).collect())


@pytest.mark.parametrize("words_a_time", [1, 50, 1 << 17])
def test_slices_do_not_matter(spark, monkeypatch, words_a_time):
    rnd = random.Random(1)
    held = [[rnd.choice("ab") for _ in range(rnd.randint(0, 120))] for _ in range(60)]
    monkeypatch.setattr(P, "WORDS", words_a_time)
    got = []
    for part, _, _ in P._document_slices([None] * 60, [" ".join(w) for w in held], None):
        got += [r for _, r in P._detect(part, 24, 3)]
    assert got == [brute(w) for w in held]


def test_long_text():
    rnd = random.Random(2)
    unit = [str(rnd.randint(0, 1 << 40)) for _ in range(100_000)]
    w = [str(k) for k in range(1000)] + unit * 3 + unit[:17] + ["end"] + ["x", "y"] * 50_000
    (kept, runs), = P._detect([w], 24, 3)
    assert runs == [(1000, 300_017, 100_000), (301_018, 100_000, 2)]
    assert len(kept) == 1000 + 100_000 + 1 + 2


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    out = P.digests(P.periodic_runs(df))
    assert out.collect() == [] and "exponent_milli" in out.columns
    with pytest.raises(ValueError):
        P.periodic_runs(df, least=2)
