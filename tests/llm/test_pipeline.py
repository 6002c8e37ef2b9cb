"""The pipeline's stages on the smallest tables, each against brute force on its own input."""

import re
from collections import Counter

import corpus_pipeline as C
from quarry.llm.common import materialize, read


def shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text).split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in C.STAGES:
        docs = materialize(stage(spark, docs, sf), "stage")
        rows = docs.collect()
        if name == "packing":
            assert {r["doc_id"] for r in rows} == set(before)
            break
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "n-gram Jaccard join":
            sets = {i: shingles(t) for i, t in before.items()}
            for i, x in sets.items():
                near = [j for j, y in sets.items() if j != i and 100 * len(x & y) >= 80 * len(x | y)]
                assert bool(near) or i in after
                assert not (i in after and any(j in after for j in near))
        if name == "suffix-array dedup":
            data = {i: t.encode() for i, t in before.items()}
            seen = Counter(t[k:k + C.PASSAGE] for t in data.values() for k in range(len(t) - C.PASSAGE + 1))
            for i, t in data.items():
                gone = bytearray(len(t))
                for k in range(len(t) - C.PASSAGE + 1):
                    if seen[t[k:k + C.PASSAGE]] > 1:
                        gone[k:k + C.PASSAGE] = b"\1" * C.PASSAGE
                left = bytes(b for b, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
                assert after.get(i, "") == (left if left.split() else "")
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        before = after
