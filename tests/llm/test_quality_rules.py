"""Operator 8: base columns against brute force; planted outliers."""

import random
import re
from collections import Counter

from quarry.llm import quality_rules as Q

SCHEMA = "doc_id bigint, text string, lang string, source string, kept string, g int, n int"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i:i + 5])] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def judged(spark, rows):
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA)
    return Q.quality_rules(df).collect()


def clean(rnd, words=120):
    w = [f"{rnd.choice('bcdfg')}{rnd.choice('aeiou')}{rnd.choice('lmnrst')}{'x' * rnd.randint(0, 4)}{rnd.randint(0, 99999)}" for _ in range(words)]
    return "\n".join(" ".join(w[i:i + 10]) for i in range(0, words, 10))


def test_base_columns_equal_brute_force(spark):
    rnd = random.Random(1)
    texts = ["", None, " \t\n", "a b", "a\x0bb\x0cc\rd " * 5, "\x1c\x1d\x85  x", "é " * 12, "# $ % *|<>&" * 4, "x\n\nx\n \nx y\nx y",
             "a b c d e f a b c d e g h i j k l m n o p q r s t u v w x y z " * 1]
    for _ in range(150):
        texts.append("".join(rnd.choice(["a", "b", "ab", "#", "|", "é"]) + rnd.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rnd.randint(0, 60))))
    rows = [(i, t, "en", None) for i, t in enumerate(texts)] + [(3, texts[3], "en", None), (None, texts[20], None, None)]
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
                 for r in judged(spark, rows) if r["doc_id"] is not None)
    assert got == sorted((i, *brute(t)) for i, t, *_ in rows if i is not None)
    assert all(not (r["kept"] and r["base_failed"]) for r in judged(spark, rows))


def test_symbols_lines_and_word_lengths_reject_alone(spark):
    rnd = random.Random(2)
    rows = [(i, clean(rnd, rnd.randint(80, 200)), "en", "web") for i in range(300)]
    lines = clean(rnd, 600).split("\n")
    short = [f"menu{i} home{i}" for i in range(3)]
    repeated = [x for i, line in enumerate(lines) for x in (line, short[i % 3])]
    bad = {900: clean(rnd).replace(" ", " ## "), 901: "\n".join(repeated), 903: " ".join("w" * 40 + str(i) for i in range(120))}
    rows += [(i, t, "en", "web") for i, t in bad.items()]
    got = {r["doc_id"]: r for r in judged(spark, rows)}
    for i in bad:
        assert not got[i]["base_failed"], i
        assert not got[i]["kept"], (i, got[i])
    assert sum(not got[i]["kept"] for i in range(300)) == 0


def test_ties_and_long_texts(spark):
    text = clean(random.Random(3))
    rows = [(i, text, None, None) for i in range(80)] + [(99, clean(random.Random(4), 200_000), None, None)]
    got = {r["doc_id"]: r for r in judged(spark, rows)}
    assert got[0]["kept"] and got[99]["n_words"] == 200_000
