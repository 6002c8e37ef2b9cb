"""Draws by hex digits against those by the parsed number, and one hash a draw."""

from pyspark.sql import functions as F

from quarry.functions.columns import hash_unit
from quarry.operators import metrics as M


def test_draws_by_digits_are_those_by_number(spark, capsys):
    df = spark.range(20000).select(F.concat(F.lit("42:"), F.col("id").cast("string")).alias("k"), "id")
    df = df.select(M.poisson1(hash_unit(42, "id")).alias("a"), M.poisson1_of(F.md5("k")).alias("b"))
    assert df.where("a <> b").count() == 0 and df.select("b").distinct().count() >= 7
    edges = spark.createDataFrame([(f"{v:08x}" + "0" * 24, v / 2.0 ** 32) for v in (0, 1580030168, 1580030169, 3160060336, 3160060337, 2 ** 32 - 1)],
                                  "h string, u double")
    assert edges.select(M.poisson1(F.col("u")).alias("a"), M.poisson1_of(F.col("h")).alias("b")).where("a <> b").count() == 0
    rows = spark.range(50).select((F.col("id") % 7).alias("y"), (F.col("id") % 5).alias("p"), "id")
    out = M.bootstrap_ci(rows, "y", "p", F.col("id"), 10)
    assert out.count() == 2
    out.explain()
    assert "conv(" not in capsys.readouterr().out
