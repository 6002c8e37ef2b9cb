"""Operator 12 against brute force over all pairs, with edge rows; masks are skipped."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lexical_search as L

DOCS = "doc_id bigint, text string, score bigint, item_id int, rank string, n int, term string"
ITEMS = "item_id string, text string, doc_id int, id string, score string"


def terms(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def brute(docs, items, k=10):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(x for _, c in counted for x in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counted:
            s = 0
            for x in terms(text):
                if c[x]:
                    m = 25 + 75 * sum(c.values()) * n_docs // total
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * c[x] // (1000 * c[x] + 8 * m))
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return out


def frames(spark, docs, items, parts=3):
    d = spark.createDataFrame([(*r, 1, 2, "r", 3, "t") for r in docs], DOCS).repartition(parts)
    return d, spark.createDataFrame([(*r, 1, "x", "y") for r in items], ITEMS)


def sample(seed, n=300):
    rnd = random.Random(seed)
    vocab = [f"w{k}" for k in range(80)] + ["É", "é", "日本", "ABC", "abc", "1a2"]
    weight = [1 / (k + 1) for k in range(len(vocab))]

    def text(size):
        return rnd.choice([" ", "-", "\n", "_"]).join(rnd.choices(vocab, weight, k=size))

    docs = [(k, text(rnd.randint(0, 60))) for k in range(n)]
    docs += [(1000 + k, docs[7][1]) for k in range(30)] + [docs[3]] * 3 + [(None, docs[3][1]), (None, None), (5000, None), (5001, ""), (5002, "!?")]
    items = [(str(k), text(rnd.randint(1, 30))) for k in range(20)]
    items += [("long", " ".join(vocab) + " " + text(300)), ("long", "w1"), ("long", "w1"), (None, "w2 W2 w3"), ("empty", ""), ("null", None), ("none", "absent")]
    return docs, items


@pytest.mark.parametrize("block,cells,step,rows", [(4 << 20, 1 << 24, 64, 4096), (200, 300, 3, 17)])
def test_equals_brute_force(spark, monkeypatch, block, cells, step, rows):
    docs, items = sample(3)
    for name, v in (("CELLS", cells), ("STEP", step), ("BATCH_ROWS", rows), ("BATCH_COUNTS", rows * 4)):
        monkeypatch.setattr(L, name, v)
    d, i = frames(spark, docs, items)
    got = sorted(map(tuple, L.lexical_search(d, i, block_bytes=block).collect()), key=str)
    assert got == sorted(brute(docs, items), key=str)


def test_string_ids_and_other_k(spark):
    docs, items = sample(5, 60)
    d, i = frames(spark, docs, items)
    d = d.withColumn("doc_id", d.doc_id.cast("string"))
    named = [(None if k is None else str(k), t) for k, t in docs]
    want = brute([(k, t) for k, t in named], items, 3)
    got = sorted(map(tuple, L.lexical_search(d, i, k=3).collect()), key=str)
    assert len(got) == len(want)
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in sorted(want, key=str)]


def test_empty_tables(spark):
    docs, items = sample(1, 20)
    d, i = frames(spark, docs, items)
    assert L.lexical_search(d.where("1 = 0"), i).collect() == []
    assert L.lexical_search(d, i.where("1 = 0")).collect() == []
    assert L.lexical_search(d, i).columns == ["item_id", "rank", "doc_id", "score"]


def test_masks_end_the_search_early():
    """Of many documents with common terms only, few are scored."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choices(["the", "of", "and"], k=rnd.randint(1, 40))) for _ in range(4000)]
    for k in range(15):
        texts[k * 200] += f" rare{k % 3}"
    vocabulary, ((t, r),) = L.item_terms(["the rare0 of rare1 rare2 and"])
    size, offsets, term, tf = L.count_terms(texts, vocabulary)
    df = np.bincount(term, minlength=len(vocabulary))
    batch = L.Batch(offsets, term, tf, np.array(size), L.weights(df, len(texts)), len(texts), sum(size))
    ranking = L.Ranking(10)
    ranking.search(batch, t, r, np.zeros(len(vocabulary), np.int64), list(range(4000)), np.arange(4000))
    assert [(x[2], -x[0]) for x in ranking.rows] == [(x[2], x[3]) for x in brute(list(enumerate(texts)), [("", "the rare0 of rare1 rare2 and")])]
    assert ranking.scored <= 2 * L.STEP


def test_long_text_and_large_numbers():
    vocabulary, _ = L.item_terms(["a b"])
    size, offsets, term, tf = L.count_terms(["a " * 1_000_000 + "c " * 500_000, None], vocabulary)
    assert (size, offsets.tolist(), term.tolist(), tf.tolist()) == ([1_500_000, 0], [0, 1, 1], [0], [1_000_000])
    n = np.array([10**9, 5])
    assert L.length_norm(n, 10**12, 10**14).tolist() == [25 + 75 * 10**9 * 10**12 // 10**14, 25 + 75 * 5 * 10**12 // 10**14]
