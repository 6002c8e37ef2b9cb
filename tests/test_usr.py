"""Point-cloud moments: one shuffle of the points, and the same for entities too large for a window."""

import random

from quarry.operators import similarity as S


def cloud(spark):
    rnd = random.Random(5)
    rows = [(e, i, rnd.random() * 9, rnd.random() * 9, rnd.random() * 9) for e in range(30) for i in range(1 + e % 9)]
    return spark.createDataFrame(rows + [(99, i, rnd.random(), rnd.random(), rnd.random()) for i in range(60)],
                                 "e bigint, i int, x double, y double, z double")


def found(df):
    return {r["e"]: [round(v, 8) for v in r["usr"]] for r in df.collect()}


def test_large_entities_go_apart(spark, monkeypatch):
    p = cloud(spark)
    one = found(S.usr_descriptor(p, "e", "i", ["x", "y", "z"]))
    monkeypatch.setattr(S, "ENTITY_POINTS", 20)
    assert found(S.usr_descriptor(p, "e", "i", ["x", "y", "z"])) == one and len(one) == 31


def test_points_are_shuffled_once(spark):
    df = S.usr_descriptor(cloud(spark), "e", "i", ["x", "y", "z"])
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
