"""Typed profiles against a plain loop, and what they shuffle."""

import math
import random
from itertools import combinations

from quarry.operators import similarity as S


def brute(points, n_dist=50):
    points = sorted(points, key=lambda p: tuple((v is not None, v) for v in (p[1], *p[3:6])))
    out = [min(10, sum(p[2] == t for p in points)) for t in S.PHARM_TYPES for _ in range(10)]
    for a, b in list(combinations(points, 2))[:n_dist]:
        none = None in a[3:6] or None in b[3:6]
        out.append(0 if none else math.floor(math.dist(a[3:6], b[3:6]) / 2) % 10)
    return out + [0] * (256 - len(out))


def test_profiles_equal_a_plain_loop(spark, capsys):
    rnd = random.Random(3)
    rows = []
    for e, n in enumerate((1, 2, 5, 11, 51, 52, 130)):
        rows += [(e, i // 2, rnd.choice([*S.PHARM_TYPES[:3], "other", None]), *(rnd.uniform(0, 60) for _ in range(3))) for i in range(n)]
    rows += [rows[-1], (2, 9, "donor", None, 1.0, 2.0), (7, None, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "e int, pid int, t string, x double, y double, z double")
    out = S.typed_profile(df, "e", "pid", "t", ["x", "y", "z"])
    out.explain()
    assert capsys.readouterr().out.count("Join") == 1  # pairs are made inside a row
    got = {r["e"]: r["profile"] for r in out.collect()}
    assert got == {e: brute([r for r in rows if r[0] == e]) for e in range(8)}
    none = S.typed_profile(df.limit(1).selectExpr("cast(null as int) as e", "pid", "t", "x", "y", "z"), "e", "pid", "t", ["x", "y", "z"])
    assert len(none.first()["profile"]) == 256
