"""Operator 13: base spans against the plain patterns, disguises, edge rows."""

import hashlib
import random
import re

import pytest

from quarry.llm import pii as P

SCHEMA = "doc_id bigint, text string, spans string, kind int, id string, t string"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def checksum(digits):
    """Luhn's rule as a sum over written-out doubles."""
    return sum(int(c) if k % 2 == 0 else sum(map(int, str(2 * int(c)))) for k, c in enumerate(digits[::-1])) % 10


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and checksum(digits) == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def base(text):
    return [f"{P.KINDS[k]}:{a}:{b}" for k, a, b in P.find(text)[0]]


def more(text):
    return [(P.KINDS[k], text[a:b]) for k, a, b in P.find(text)[1]]


def fuzz(seed, alphabet, size):
    rnd = random.Random(seed)
    return "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, size)))


@pytest.mark.parametrize("alphabet", ["a@.-_ ", "1.", "12 -", "+1 ().-x", "a1@.+- (é\n", "0123456789. ", ["192", ".", "256", "0", " ", "a"],
                                      ["4", "1", "0000", " ", "-", "4111111111111111", "x"]])
def test_base_equals_the_patterns(alphabet):
    for seed in range(3000):
        text = fuzz(seed, alphabet, 60)
        assert base(text) == brute(text), text


CARD = "4111111111111111"
DISGUISED = [
    ("mail john (at) example (dot) com now", [("email", "john (at) example (dot) com")]),
    ("mail john[at]example[dot]com", [("email", "john[at]example[dot]com")]),
    ("john.doe { AT } mail.example.org", [("email", "john.doe { AT } mail.example.org")]),
    ("write to jane at example dot com please", [("email", "jane at example dot com")]),
    ("jane dot roe at mail dot example dot org.", [("email", "jane dot roe at mail dot example dot org")]),
    ("jane@example dot com", [("email", "jane@example dot com")]),
    ("jаne@exаmple.com", [("email", "jаne@exаmple.com")]),
    ("jane＠example．com", [("email", "jane＠example．com")]),
    ("ja​ne@exam­ple.com", [("email", "ja​ne@exam­ple.com")]),
    ("host 192[.]168[.]0[.]1 down", [("ip", "192[.]168[.]0[.]1")]),
    ("host 192 dot 168 dot 0 dot 1", [("ip", "192 dot 168 dot 0 dot 1")]),
    ("host one nine two dot one six eight dot zero dot one ok", [("ip", "one nine two dot one six eight dot zero dot one")]),
    ("l92.168.O.1", [("ip", "l92.168.O.1")]),
    ("card " + " ".join("four one one one".split() * 1 + ["one"] * 12) + " end",
     [("card", "four one one one" + " one" * 12)]),
    ("vier eins eins eins " + "eins " * 12, [("card", ("vier eins eins eins " + "eins " * 12).strip())]),
    ("4ll1 1111 1111 1111", [("card", "4ll1 1111 1111 1111")]),
    ("４" + CARD[1:], [("card", "４" + CARD[1:])]),
    ("4111 1111‑1111 1111", [("card", "4111 1111‑1111 1111")]),
    ("call plus one five five five zero one two three four five six seven", [("phone", "plus one five five five zero one two three four five six seven")]),
    ("call ＋1 555 012 3456", [("phone", "＋1 555 012 3456")]),
    ("٤١١١" + "1" * 12, [("card", "٤١١١" + "1" * 12)]),
]
CLEAN = ["", "look at example.com today", "meet me at noon. dot", "he stood at the dot of noon", "one two three four", "un six sept",
         "plus 10 000 000 euros", "in plus 12345678", "the a (at) b", "a[.]b", "Ол и Оля at home", "I am l0 and O2", "x at y dot", "version 1.2.3.4.5"]


@pytest.mark.parametrize("text,want", DISGUISED)
def test_disguised(text, want):
    assert more(text) == want
    assert base(text) == brute(text)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay(text):
    assert more(text) == []


def test_plain_spans_are_not_repeated():
    text = "a@b.co, (at) 10.0.0.1 +1 (555) 555-1234 x " + CARD + " c (at) d.org"
    assert base(text) == brute(text) and len(brute(text)) == 4
    assert more(text) == [("email", "c (at) d.org")]


def test_places_are_code_points():
    text = "\U0001F600é john(at)example.com \U0001F600 a@b.co"
    (_, a, b), = P.find(text)[1]
    assert text[a:b] == "john(at)example.com"
    assert base(text) == brute(text)


def test_table(spark):
    texts = [t for t, _ in DISGUISED] + CLEAN + [None, "a@b.co x@y.z 1.2.3.4 " + CARD, "\x00a@b.c\x00"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a@b.co"), (None, None), (0, texts[0])]
    df = spark.createDataFrame([(*r, "s", 1, "i", "t") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in P.digests(P.personal_data(df)).collect()), key=str)
    want = []
    for k, t in rows:
        b = brute(t)
        order = {k: i for i, k in enumerate(PLAIN)}
        spans = b + [f"{P.KINDS[x]}:{s}:{e}" for x, s, e in P.find(t)[1]] if t else []
        spans.sort(key=lambda s: (order[s.split(":")[0]], *map(int, s.split(":")[1:])))
        want.append((k, *(sum(s.startswith(kind) for s in b) for kind in PLAIN),
                     hashlib.sha256(",".join(b).encode()).hexdigest(), ",".join(spans)))
    assert got == sorted(want, key=str)
    assert P.digests(P.personal_data(df.where("1 = 0"))).collect() == []


def test_redact(spark):
    rows = [(1, "mail john (at) example (dot) com or a@b.co."), (2, None), (3, "\U0001F600 10.0.0.1"), (None, "clean"), (3, "\U0001F600 10.0.0.1")]
    df = spark.createDataFrame([(*r, "s", 1, "i", "t") for r in rows], SCHEMA)
    out = P.redact(df)
    assert out.columns == df.columns
    got = sorted(((r["doc_id"], r["text"], r["spans"]) for r in out.collect()), key=str)
    assert got == sorted([(1, "mail [email] or [email].", "s"), (2, None, "s"), (3, "\U0001F600 [ip]", "s"), (3, "\U0001F600 [ip]", "s"),
                          (None, "clean", "s")], key=str)


@pytest.mark.parametrize("text", ["a" * 300_000, "a@" * 150_000, "1" * 300_000, "1." * 150_000, "+1" + " " * 300_000, "+1 " * 100_000,
                                  "one " * 75_000, "(at) " * 60_000, "a dot " * 50_000, "a at b dot " * 30_000, "l0" * 150_000, "a." * 150_000 + "@",
                                  "a dot " * 50_000 + "b(at)c.com", "one one onex " * 30_000, "b at " + "c." * 100_000, "b at " * 50_000 + "c dot com"])
def test_long_texts_take_linear_time(text):
    import time

    t0 = time.time()
    P.find(text)
    assert time.time() - t0 < 5
