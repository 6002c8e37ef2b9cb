"""Operator 7: base columns and template windows against brute force, false labels."""

import random
import re

import pytest

from quarry.llm import license_scan as L

SCHEMA = "doc_id bigint, text string, labels string, words int, w string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(doc_id, text):
    w = words(text)
    at = [(i, label) for p, label in L.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    names, top = set(), 0.0
    for name, t in L.TEMPLATES.items():
        t, need = t.split(), set(L.REQUIRED.get(name, "").split())
        for i in range(max(1, len(w) - len(t) + 1)):
            window = set(w[i:i + len(t)])
            share = len(window & set(t)) / len(set(t))
            if 100 * len(window & set(t)) >= L.CONTAINMENT * len(set(t)) and need <= window:
                names.add(name)
                top = max(top, share)
    base = sorted({label for _, label in at})
    return (doc_id, len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(base),
            ",".join(sorted(names | set(base))), 1.0 if at else top)


def scanned(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in L.license_scan(df).collect()), key=str)


def texts():
    rnd = random.Random(4)
    vocab = sorted({x for t in [*L.TEMPLATES.values(), *L.PHRASES] for x in t.split()}) + ["film", "é", "bsd", "x1"]
    out = ["", None, " \n", "MIT License", "the mit license, mit license gnu general public license", "cc by cc by"]
    for _ in range(150):
        parts = []
        for _ in range(rnd.randint(1, 5)):
            t = rnd.choice([*L.TEMPLATES.values(), *L.PHRASES]).split()
            for _ in range(rnd.randint(0, 3)):
                at = rnd.randrange(max(1, len(t)))
                t[at:at + rnd.randint(0, 1)] = rnd.choices(vocab, k=rnd.randint(0, 2))
            parts += t + rnd.choices(vocab, k=rnd.randint(0, 6))
        out.append("".join(x.title() + rnd.choice([" ", "\n", ", ", "-"]) if rnd.random() < 0.5 else x + " " for x in parts))
    return out


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    rows += [rows[7], (None, "Released under the MIT license"), (None, None)]
    assert scanned(spark, rows) == sorted((brute(*r) for r in rows), key=str)


@pytest.mark.parametrize("text", [
    "This software is released under the BSD license.", "released under the GNU General Public License",
    "The film was released under the license of the studio.", "",
    " ".join(["filler"] * 300 + ["released"] + ["filler"] * 300 + ["under"] + ["filler"] * 300 + ["the"] + ["filler"] * 300 + ["license"])])
def test_no_false_notice(spark, text):
    (row,) = scanned(spark, [(1, text)])
    assert "mit-notice" not in row[6].split(",")


def test_line_breaks_and_ties(spark):
    grant = L.TEMPLATES["mit-grant"].split()
    wrapped = " ".join(grant[:9]) + "\n" + " ".join(grant[9:])
    both = "Released under the MIT license.\nLicensed under the Apache License, Version 2.0"
    got = scanned(spark, [(1, wrapped), (2, both)])
    assert got[0][6] == "mit-grant" and got[0][7] == 1.0
    assert got[1][6] == "apache,apache-2.0-notice,mit,mit-notice"


def test_long_text(spark):
    text = "the film was released " * 60_000 + "Released under the MIT licence mit license"
    (row,) = scanned(spark, [(1, text)])
    assert row[1] == 240_007 and row[2:7] == (1, 240_005, 240_005, "mit", "mit,mit-notice")
