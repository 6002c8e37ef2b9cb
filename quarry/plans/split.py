"""Registered split / sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import split as H
from ..sources.tables import table
from .common import hsql, hunit_sql, r
from .registry import query


def _orders(spark, sf, *cols):
    return table(spark, sf, "orders").select("o_orderkey", *cols)


@query("h01_kfold", f"SELECT o_orderkey, CAST({hsql(42, 'o_orderkey')} % 5 AS INT) AS fold FROM orders")
def h01(spark, sf):
    return H.kfold(_orders(spark, sf), "o_orderkey", 5, 42)


@query("h02_stratified_kfold", f"""
SELECT o_orderkey, o_orderstatus, CAST((row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY {hsql(42, 'o_orderkey')}, o_orderkey) - 1) % 5 AS INT) AS fold FROM orders""")
def h02(spark, sf):
    return H.stratified_kfold(_orders(spark, sf, "o_orderstatus"), "o_orderkey", "o_orderstatus", 5, 42)


_SERP = "CASE WHEN floor(p / 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END"


@query("h03_group_kfold", f"""
WITH s AS (SELECT o_custkey, count(*) AS sz FROM orders GROUP BY o_custkey),
r AS (SELECT o_custkey, row_number() OVER (ORDER BY -sz, o_custkey) - 1 AS p FROM s)
SELECT o_orderkey, o.o_custkey, CAST({_SERP} AS INT) AS fold FROM orders o JOIN r USING (o_custkey)""")
def h03(spark, sf):
    return H.group_kfold(_orders(spark, sf, "o_custkey"), "o_custkey", 5).select("o_orderkey", "o_custkey", "fold")


@query("h03_leave_one_group_out", """
SELECT n_nationkey, n_regionkey, CAST(dense_rank() OVER (ORDER BY n_regionkey) - 1 AS INT) AS fold FROM nation""")
def h03b(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    return H.leave_one_group_out(n, "n_regionkey").select("n_nationkey", "n_regionkey", "fold")


@query("h04_group_lpt", """
WITH RECURSIVE s AS (SELECT p_type, count(*) AS sz, row_number() OVER (ORDER BY count(*) DESC, p_type) AS rn FROM part GROUP BY p_type),
d AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, CAST(0 AS BIGINT) AS c, -1 AS fold
UNION ALL SELECT s.rn, q.a + CASE WHEN q.f = 0 THEN s.sz ELSE 0 END, q.b + CASE WHEN q.f = 1 THEN s.sz ELSE 0 END,
  q.c + CASE WHEN q.f = 2 THEN s.sz ELSE 0 END, q.f
  FROM (SELECT *, CASE WHEN a <= b AND a <= c THEN 0 WHEN b <= c THEN 1 ELSE 2 END AS f FROM d) q JOIN s ON s.rn = q.rn + 1)
SELECT p_partkey, p_type, fold FROM part JOIN s USING (p_type) JOIN d USING (rn)""")
def h04(spark, sf):
    return H.group_lpt(table(spark, sf, "part").select("p_partkey", "p_type"), "p_type", 3)


@query("h05_group_shuffle_split", f"""
WITH s AS (SELECT p_brand, count(*) AS sz, {hsql(42, 'p_brand')} AS h FROM part GROUP BY p_brand),
c AS (SELECT p_brand, sum(sz) OVER (ORDER BY h, p_brand ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sz AS before,
      sum(sz) OVER () AS total FROM s)
SELECT p_partkey, p_brand, CASE WHEN before < 0.2 * total THEN 'test' ELSE 'train' END AS split
FROM part JOIN c USING (p_brand)""")
def h05(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_brand")
    return H.group_shuffle_split(p, "p_brand", 0.2, 42).select("p_partkey", "p_brand", "split")


@query("h06_time_series_split", """
SELECT o_orderkey, CAST(ntile(6) OVER (ORDER BY o_orderdate, o_orderkey) AS INT) AS tile FROM orders""")
def h06(spark, sf):
    return H.time_series_split(_orders(spark, sf, "o_orderdate"), "o_orderdate", "o_orderkey", 5).select(
        "o_orderkey", "tile")


@query("h06_time_series_folds", """
WITH t AS (SELECT ntile(6) OVER (ORDER BY o_orderdate, o_orderkey) AS tile FROM orders),
s AS (SELECT tile, unnest(range(1, 6)) AS split FROM t)
SELECT CAST(split AS INT) AS split, CASE WHEN tile = split + 1 THEN 'test' ELSE 'train' END AS role,
       count(*) AS n FROM s WHERE tile <= split + 1 GROUP BY 1, 2""")
def h06b(spark, sf):
    t = H.time_series_split(_orders(spark, sf, "o_orderdate"), "o_orderdate", "o_orderkey", 5)
    return H.time_series_folds(t, 5).groupBy("split", "role").agg(F.count(F.lit(1)).alias("n"))


@query("h07_repeated_kfold", f"""
SELECT o_orderkey, CAST(rep AS INT) AS repeat,
  CAST({hsql(42, "CAST(rep AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR)")} % 5 AS INT) AS fold
FROM orders, range(0, 10) t(rep)""")
def h07(spark, sf):
    return H.repeated_kfold(_orders(spark, sf), "o_orderkey", 5, 10, 42)


@query("h07_repeated_stratified_kfold", f"""
SELECT o_orderkey, o_orderstatus, CAST(rep AS INT) AS repeat, CAST((row_number() OVER (PARTITION BY rep, o_orderstatus
  ORDER BY {hsql(42, "CAST(rep AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR)")}, o_orderkey) - 1) % 5 AS INT) AS fold
FROM orders, range(0, 3) t(rep)""")
def h07s(spark, sf):
    o = _orders(spark, sf, "o_orderstatus")
    return H.repeated_stratified_kfold(o, "o_orderkey", "o_orderstatus", 5, 3, 42)


@query("h08_shuffle_split", f"""
SELECT o_orderkey, CAST(s AS INT) AS split,
  CASE WHEN {hunit_sql(42, "CAST(s AS VARCHAR) || ':' || CAST(o_orderkey AS VARCHAR)")} < 0.2 THEN 'test' ELSE 'train' END AS role
FROM orders, range(0, 10) t(s)""")
def h08(spark, sf):
    return H.shuffle_split(_orders(spark, sf), "o_orderkey", 10, 0.2, 42)


@query("h08_stratified_shuffle_split", f"""
SELECT o_orderkey, o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY {hsql(42, 'o_orderkey')}, o_orderkey) <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2)
  THEN 'test' ELSE 'train' END AS role FROM orders""")
def h08b(spark, sf):
    return H.stratified_shuffle_split(_orders(spark, sf, "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.2, 42)


@query("h09_stratified_group_kfold")
def h09(spark, sf):
    o = _orders(spark, sf, "o_custkey", "o_orderstatus")
    return H.stratified_group_kfold(o, "o_custkey", "o_orderstatus", 5)


@query("h10_leave_one_out", "SELECT n_nationkey, n_nationkey AS fold FROM nation")
def h10(spark, sf):
    return H.leave_one_out(table(spark, sf, "nation").select("n_nationkey"), "n_nationkey")


@query("h11_predefined_split", """
SELECT o_orderkey, CAST(CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE o_custkey % 3 END AS INT) AS fold,
  CASE WHEN o_orderpriority = '5-LOW' THEN -1 ELSE o_custkey % 3 END <> -1 AS in_test FROM orders""")
def h11(spark, sf):
    o = _orders(spark, sf, "o_orderpriority", "o_custkey").withColumn(
        "pf", F.when(F.col("o_orderpriority") == "5-LOW", -1).otherwise(F.col("o_custkey") % 3))
    return H.predefined_split(o, "pf").select("o_orderkey", "fold", "in_test")


@query("h12_train_val_test", f"""
SELECT o_orderkey, CASE WHEN {hunit_sql(42, 'o_orderkey')} < 0.2 THEN 'test'
  WHEN {hunit_sql(42, 'o_orderkey')} < 0.30000000000000004 THEN 'val' ELSE 'train' END AS role FROM orders""")
def h12(spark, sf):
    return H.train_test(_orders(spark, sf), "o_orderkey", 0.2, 0.1, 42)


@query("h12_stratified_train_test", f"""
WITH x AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus
  ORDER BY {hsql(42, 'o_orderkey')}, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderkey, o_orderstatus, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS role FROM x""")
def h12b(spark, sf):
    return H.train_test(_orders(spark, sf, "o_orderstatus"), "o_orderkey", 0.2, 0.0, 42, "o_orderstatus")


@query("h13_uncertainty_sample", """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 + l_tax) - l_extendedprice * (1 - l_discount) AS width
FROM lineitem ORDER BY width DESC, l_orderkey, l_linenumber LIMIT 10""")
def h13(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("lo"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("hi"))
    return H.uncertainty_sample(li, ["l_orderkey", "l_linenumber"], "lo", "hi", 10).select(
        "l_orderkey", "l_linenumber", "width")


def _phi_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0))"
    t = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    poly = (f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + "
            f"{t} * 1.061405429)))))")
    erf = f"(1.0 - {poly} * exp(-{x} * {x}))"
    return f"(CASE WHEN {z} >= 0 THEN (1.0 + {erf}) / 2 ELSE (1.0 - {erf}) / 2 END)"


@query("h15_expected_improvement", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS m,
  (l_extendedprice * (1 + l_tax) - l_extendedprice * (1 - l_discount)) / 4 AS sd FROM lineitem),
y AS (SELECT *, (m - 50000.0) / (sd + 1e-9) AS z FROM x)
SELECT l_orderkey, l_linenumber,
  {r(f"(m - 50000.0) * {_phi_sql('z')} + sd * exp(-z * z / 2) / sqrt(2 * pi())", 4)} AS ei FROM y""")
def h15(spark, sf):
    li = table(spark, sf, "lineitem")
    lo = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    hi = F.col("l_extendedprice") * (1 + F.col("l_tax"))
    ei = H.expected_improvement(F.col("l_extendedprice"), lo, hi, 50000.0)
    return li.select("l_orderkey", "l_linenumber", r6(ei, 4).alias("ei"))


_LHS_BOUNDS = [(0.0, 1.0), (10.0, 20.0), (-5.0, 5.0)]


def _lhs_sql():
    dk = "CAST(dim AS VARCHAR) || ':' || CAST(p_partkey AS VARCHAR)"
    lo = "[" + ", ".join(str(b[0]) for b in _LHS_BOUNDS) + "][dim + 1]"
    hi = "[" + ", ".join(str(b[1]) for b in _LHS_BOUNDS) + "][dim + 1]"
    return f"""
WITH x AS (SELECT p_partkey, CAST(dim AS INT) AS dim FROM part, range(0, 3) t(dim)),
y AS (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY {hsql(42, dk)}, p_partkey) - 1 AS st,
             count(*) OVER (PARTITION BY dim) AS n FROM x)
SELECT p_partkey, dim, CAST(st AS INT) AS stratum,
  {r(f"{lo}::DOUBLE + ({hi}::DOUBLE - {lo}::DOUBLE) * (st + {hunit_sql('42u', dk)}) / n")} AS value FROM y"""


@query("h16_latin_hypercube", _lhs_sql())
def h16(spark, sf):
    pts = H.latin_hypercube(table(spark, sf, "part"), "p_partkey", 3, _LHS_BOUNDS, 42)
    return pts.withColumn("value", r6(F.col("value")))


def _pool(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "embedding", F.col("embedding")[0].cast("double").alias("lo"),
                    (F.col("embedding")[0] + F.abs(F.col("embedding")[1])).cast("double").alias("hi"))


@query("h14_diversity_sample")
def h14(spark, sf):
    return H.diversity_sample(_pool(spark, sf), "vec_id", "embedding", 10)


@query("h14_hybrid_sample")
def h14h(spark, sf):
    return H.hybrid_sample(_pool(spark, sf), "vec_id", "embedding", "lo", "hi", 10)
