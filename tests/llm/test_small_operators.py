"""Operators 1, 3, 6, 7, 8 and 9 against the library or brute force, with edge rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quarry.llm import decontaminate as D
from quarry.llm.language_id import Trie, forward, identify
from quarry.llm.license_scan import license_scan
from quarry.llm.packing import pack, plan
from quarry.llm.quality_rules import keep_good, quality_rules
from quarry.llm.token_counts import token_counts

BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, id string, t string, n int"
TEXTS = ["Hello  world\n\n it's 12,5 <|endoftext|>x", "日本 é\t\n Ünïcode", "", None, " ", "a" * 3000, "the MIT License mit license. " * 9,
         "word " * 2000, "Licensed under the Apache License, Version 2.0.", "x\n \ny  z", "\U00016460\U0001915aé ab"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, "x", 1) for r in rows], SCHEMA)


def documents():
    rows = [(i, t, "en", "a") for i, t in enumerate(TEXTS)]
    return rows + [rows[0], (None, "no id", None, None), (None, None, None, None)]


def library(text):
    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


def test_token_counts_equal_the_library(spark):
    got = sorted(map(tuple, token_counts(frame(spark, documents()), BPE).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library(t)), n > 512) for i, t, *_ in documents()]
    assert got == sorted(want, key=str)


def test_packing_round_trip(spark):
    rows = [(i, t, "en", "a") for i, t in enumerate([t for t in TEXTS if t] * 3)] + [(100, None, None, None)]
    got = pack(frame(spark, rows), BPE).collect()
    docs, seqs = {}, {}
    for r in got:
        docs.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    assert len(docs) == len(rows)
    for i, t, *_ in rows:
        ids, at = [*library(t), 1], 0
        for r in sorted(docs[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at:at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048


def test_plan_is_optimal():
    rnd = random.Random(3)
    for _ in range(50):
        points = sorted(rnd.sample(range(1, 60), 12))
        points = [p for k, p in enumerate(points) if p - ([0] + points)[k] <= 16]
        points = sorted({*points, *range(8, points[-1], 8)})
        prices = [rnd.choice([0.0, 2.0]) for _ in points]

        def cost(cuts):
            total, last = 0.0, 0
            for c in cuts:
                assert 0 < c - last <= 16
                total += (16 - (c - last)) + prices[points.index(c)]
                last = c
            return total

        best = {0: 0.0}
        for p, price in zip(points, prices, strict=True):
            best[p] = min(best[q] + 16 - (p - q) for q in best if p - q <= 16) + price
        assert cost(plan(points, prices, 16)) == pytest.approx(best[points[-1]])


def spans(words, windows):
    hit = set()
    for w in windows:
        for i in range(len(words) - len(w) + 1):
            if words[i:i + len(w)] == w:
                hit.update(range(i, i + len(w)))
    return hit


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.mark.parametrize("block", [16 << 20, 60])
def test_decontamination_equals_brute_force(spark, block):
    rnd = random.Random(1)
    say = lambda n: " ".join(rnd.choice("aa BB cé dd ee ff".split()) for _ in range(n))
    items = [(i, say(rnd.randrange(0, 9))) for i in range(12)] + [(12, None), (None, "Zz yy"), (3, "aa zz")]
    rows = [(i, say(rnd.randrange(0, 60)), "en", "a") for i in range(40)] + documents() + [(50, "zz, YY zz", "en", "a")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, t string")
    got = D.decontaminate(frame(spark, rows), bench, size=4, block_bytes=block).drop("items").collect()
    want = []
    for i, t, *_ in rows:
        w, hit, found = tokens(t), set(), set()
        for item, text in items:
            x = tokens(text)
            h = spans(w, [x[k:k + 4] for k in range(max(1, len(x) - 3))] if x else [])
            hit |= h
            if h:
                found.add("" if item is None else str(item))
        want.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    clean = D.clean(frame(spark, rows), bench, size=4)
    assert clean.count() == sum(not w[5] for w in want) and clean.columns == frame(spark, rows).columns
    empty = D.decontaminate(frame(spark, rows), bench.limit(0)).where("contaminated")
    assert empty.count() == 0


def test_licences(spark):
    got = {(r["doc_id"], r["n_words"]): r for r in license_scan(frame(spark, documents())).collect()}
    r = got[6, 45]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (18, 1, 43, "mit", 1.0)
    r = got[8, 8]
    assert (r["base_labels"], r["labels"], r["first_word"]) == ("apache", "apache,apache-2.0-notice", 3)
    assert got[3, 0]["n_base"] == 0 and got[3, 0]["first_word"] is None and got[3, 0]["labels"] == ""
    text = "intro\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software"
    r = license_scan(frame(spark, [(1, text, "en", "a")]), percent=60).collect()[0]
    assert r["labels"] == "mit-grant" and 0.6 <= r["score"] < 1 and r["n_base"] == 0


def test_license_templates_over_line_breaks(spark):
    mit = ("x y\n# Permission is hereby granted, free of charge, to any\n# person obtaining a copy\n"
           "# of this software and associated documentation files (the\n# Software)")
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:"
    apart = " ".join(f"{w} a b c d\n" for w in "permission is hereby granted free of charge to any person obtaining a copy".split())
    got = {r["doc_id"]: r for r in license_scan(frame(spark, [(i, t, "en", "a") for i, t in enumerate([mit, bsd, apart])])).collect()}
    assert [got[i]["labels"] for i in range(3)] == ["mit-grant", "bsd-clause", ""]
    assert got[0]["score"] == got[1]["score"] == 1.0 and got[2]["score"] == 0.0


def test_quality_base_and_outliers(spark):
    rnd = random.Random(4)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(3, 8))) for _ in range(n))
    rows = [(i, say(rnd.randrange(60, 200)), "en", "a") for i in range(120)]
    rows += [(200, " ".join(w + "###" for w in say(100).split()), "en", "a"), (201, "x y z a b " * 30, "en", "a"), (202, "few words", None, None)]
    rows += documents()
    got = {}
    for r in quality_rules(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], r)
    assert all(got[i]["kept"] for i in range(20, 120)) and not got[200]["base_failed"] and not got[200]["kept"]
    assert got[201]["base_failed"] and got[201]["n_repeat_words"] == 150 and got[202]["base_failed"]
    kept = keep_good(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and 200 not in {r["doc_id"] for r in kept.collect()}


def test_forward_sums_all_segmentations():
    tree = Trie(PIECES)
    words = ["the", "étation", "zzq", "ß日"]
    size, found = tree.matches(words)
    prob = np.random.default_rng(1).random((tree.size + 1, 2))
    alpha = forward(size, found, prob)
    for w, word in enumerate(words):
        def total(i):
            if i == len(word):
                return np.ones(2)
            out = np.zeros(2)
            for (a, j), (ids, p) in found.items():
                if a == i and w in ids:
                    out = out + prob[p[list(ids).index(w)]] * total(j)
            return out
        assert alpha[w, len(word)] == pytest.approx(total(0))


def test_language_held_out(spark):
    rnd = random.Random(6)
    stock = {"en": "the of and that with this from for were thing".split(), "de": "der die und nicht mit von ein sich auch über".split()}
    rows = [(i, " ".join(rnd.choice(stock[k]) for _ in range(20)), k, "a") for i, k in enumerate(["en", "de"] * 60)]
    rows += [(500, None, None, None), (501, "12 !?", "en", "a"), (None, "the", None, None)]
    got = {r["doc_id"]: r for r in identify(frame(spark, rows), PIECES).collect()}
    assert all(got[i]["lang_pred"] == k for i, _, k, _ in rows[:120])
    assert got[500]["lang_pred"] == got[501]["lang_pred"] == "und" and got[None]["lang_pred"] == "en"
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items() if i is not None)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_empty_tables(spark):
    none = frame(spark, [])
    for out in (token_counts(none, BPE), pack(none, BPE), license_scan(none), quality_rules(none), keep_good(none), identify(none, PIECES)):
        assert out.collect() == []
