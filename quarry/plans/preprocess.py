"""Registered preprocessing queries."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import preprocess as G
from ..operators import split as H
from ..operators.validate import column_types
from ..sources.tables import table
from .common import LI_NULL_CTE, hsql, hunit_sql, lineitem_nulls, r
from .registry import query

_IMP = ["l_discount", "l_tax"]
_KEY = ["l_orderkey", "l_linenumber"]


def _imp_query(strategy):
    def fn(spark, sf):
        li = lineitem_nulls(spark, sf).select(*_KEY, *_IMP)
        out = G.apply_imputer(li, G.fit_imputer(li, _IMP, strategy), _IMP)
        return out.select(*_KEY, *[r6(F.col(c)).alias(c) for c in _IMP])
    return fn


def _imp_sql(stat):
    return f"WITH {LI_NULL_CTE} SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"{r(f'coalesce({c}, (SELECT {stat(c)} FROM li))')} AS {c}" for c in _IMP) + " FROM li"


query("g01_impute_mean", _imp_sql(lambda c: f"avg({c})"))(_imp_query("mean"))
query("g01_impute_median", _imp_sql(lambda c: f"quantile_cont({c}, 0.5)"))(_imp_query("median"))
query("g01_impute_most_frequent", f"WITH {LI_NULL_CTE} SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{r(f'coalesce({c}, (SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM li WHERE {c} IS NOT NULL GROUP BY 1) ORDER BY n DESC, v LIMIT 1))')} AS {c}"
    for c in _IMP) + " FROM li")(_imp_query("most_frequent"))
query("g01_impute_constant", f"WITH {LI_NULL_CTE} SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{r(f'coalesce({c}, 0.0)')} AS {c}" for c in _IMP) + " FROM li")(
    lambda spark, sf: (lambda li: G.apply_imputer(li, G.fit_imputer(li, _IMP, "constant", 0.0), _IMP).select(
        *_KEY, *[r6(F.col(c)).alias(c) for c in _IMP]))(lineitem_nulls(spark, sf).select(*_KEY, *_IMP)))


@query("g02_impute_method_choice", f"""WITH {LI_NULL_CTE}
SELECT column_name, {r('rate')} AS missing_rate, CASE WHEN rate > 0.3 THEN 'iterative' WHEN rate > 0.1 THEN 'knn' ELSE 'simple' END AS method
FROM (SELECT 'l_quantity' AS column_name, count_if(l_quantity IS NULL) / count(*) AS rate FROM li
      UNION ALL SELECT 'l_discount', count_if(l_discount IS NULL) / count(*) FROM li
      UNION ALL SELECT 'l_tax', count_if(l_tax IS NULL) / count(*) FROM li)""")
def g02(spark, sf):
    out = G.impute_method_choice(lineitem_nulls(spark, sf), ["l_quantity", "l_discount", "l_tax"])
    return out.withColumn("missing_rate", r6(F.col("missing_rate")))


@query("g05_missing_indicators", f"""WITH {LI_NULL_CTE}
SELECT l_orderkey, l_linenumber, CAST(l_discount IS NULL AS INT) AS missing_l_discount, CAST(l_tax IS NULL AS INT) AS missing_l_tax FROM li""")
def g05(spark, sf):
    li = lineitem_nulls(spark, sf)
    cols = G.columns_with_missing(li, ["l_quantity", "l_discount", "l_tax"])
    return G.missing_indicators(li.select(*_KEY, *cols), cols).select(*_KEY, *[f"missing_{c}" for c in cols])


_CL = ["l_extendedprice", "l_quantity"]


def _clip_sql(lo, hi):
    b = ", ".join(f"{lo(c)} AS lo_{c}, {hi(c)} AS hi_{c}" for c in _CL)
    return (f"WITH b AS (SELECT {b} FROM lineitem) SELECT l_orderkey, l_linenumber, "
            + ", ".join(f"{r(f'least(greatest(CAST({c} AS DOUBLE), lo_{c}), hi_{c})')} AS {c}" for c in _CL)
            + " FROM lineitem, b")


def _clip_query(method, t):
    def fn(spark, sf):
        li = table(spark, sf, "lineitem").select(*_KEY, *_CL)
        out = G.apply_clip(li, G.fit_clip(li, _CL, method, t), _CL)
        return out.select(*_KEY, *[r6(F.col(c)).alias(c) for c in _CL])
    return fn


query("g06_clip_iqr", _clip_sql(
    lambda c: f"quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))",
    lambda c: f"quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))(_clip_query("iqr", 1.5))
query("g06_clip_zscore", _clip_sql(
    lambda c: f"avg({c}) - 2.0 * CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END",
    lambda c: f"avg({c}) + 2.0 * CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END"))(_clip_query("zscore", 2.0))
query("g06_clip_percentile", _clip_sql(lambda c: f"quantile_cont({c}, 0.01)", lambda c: f"quantile_cont({c}, 0.99)"))(
    _clip_query("percentile", 0.0))

_SC = ["l_extendedprice", "l_quantity", "l_discount"]


def _scale_sql(center, scale):
    b = ", ".join(f"{center(c)} AS c_{c}, CASE WHEN {scale(c)} = 0 OR {scale(c)} IS NULL THEN 1.0 ELSE {scale(c)} END AS s_{c}"
                  for c in _SC)
    return (f"WITH b AS (SELECT {b} FROM lineitem) SELECT l_orderkey, l_linenumber, "
            + ", ".join(f"{r(f'({c} - c_{c}) / s_{c}')} AS {c}" for c in _SC) + " FROM lineitem, b")


def _scale_query(method, inverse=False):
    def fn(spark, sf):
        li = table(spark, sf, "lineitem").select(*_KEY, *_SC)
        st = G.fit_scaler(li, _SC, method)
        out = G.apply_scaler(li, st, _SC)
        if inverse:
            out = G.inverse_scaler(out, st, _SC)
        return out.select(*_KEY, *[r6(F.col(c)).alias(c) for c in _SC])
    return fn


query("g07_scale_standard", _scale_sql(lambda c: f"avg({c})", lambda c: f"stddev_pop({c})"))(_scale_query("standard"))
query("g07_scale_minmax", _scale_sql(lambda c: f"CAST(min({c}) AS DOUBLE)", lambda c: f"CAST(max({c}) - min({c}) AS DOUBLE)"))(
    _scale_query("minmax"))
query("g07_scale_robust", _scale_sql(lambda c: f"quantile_cont({c}, 0.5)",
                                     lambda c: f"(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))(_scale_query("robust"))
query("g16_inverse_scale", "SELECT l_orderkey, l_linenumber, " + ", ".join(f"{r(c)} AS {c}" for c in _SC) + " FROM lineitem")(
    _scale_query("standard", inverse=True))


@query("g07_normalize_rows", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"{r(f'CASE WHEN nn = 0 THEN {c} ELSE {c} / nn END')} AS {c}" for c in _SC)
    + " FROM (SELECT *, sqrt(" + " + ".join(f"{c} * {c}" for c in _SC) + ") AS nn FROM lineitem)")
def g07n(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(*_KEY, *G.normalize_rows(_SC)).select(*_KEY, *[r6(F.col(c)).alias(c) for c in _SC])


@query("g07_binarize", "SELECT l_orderkey, l_linenumber, CAST(l_discount > 0.05 AS DOUBLE) AS l_discount FROM lineitem")
def g07b(spark, sf):
    return table(spark, sf, "lineitem").select(*_KEY, G.binarize("l_discount", 0.05))


@query("g08_auto_scale", """
WITH s AS (SELECT avg(l_extendedprice) AS m1, stddev_samp(l_extendedprice) AS s1, avg(l_quantity) AS m2, stddev_samp(l_quantity) AS s2,
  avg(l_discount) AS m3, stddev_samp(l_discount) AS s3 FROM lineitem),
z AS (SELECT greatest(max(abs((l_extendedprice - m1) / s1)), max(abs((l_quantity - m2) / s2)), max(abs((l_discount - m3) / s3))) AS mz FROM lineitem, s)
SELECT round(mz, 6) AS max_abs_z, CASE WHEN mz > 3.0 THEN 'robust' ELSE 'standard' END AS method FROM z""")
def g08(spark, sf):
    out = G.auto_scale_method(table(spark, sf, "lineitem"), _SC)
    return out.withColumn("max_abs_z", r6(F.col("max_abs_z")))


@query("g09_yeo_johnson")
def g09(spark, sf):
    li = table(spark, sf, "lineitem").select(*_KEY, "l_extendedprice")
    lam = G.fit_yeo_johnson(li, "l_extendedprice")
    return G.apply_yeo_johnson(li, "l_extendedprice", lam).withColumn("lambda", F.lit(lam))


@query("g09_quantile_transform")
def g09q(spark, sf):
    li = table(spark, sf, "lineitem").select(*_KEY, "l_extendedprice")
    refs = G.fit_quantile_transform(li, "l_extendedprice", 1000)
    return G.apply_quantile_transform(li, "l_extendedprice", refs, "normal")


@query("g10_polynomial", "SELECT p_partkey, 1.0 AS bias, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, "
       "CAST(p_size * p_size AS DOUBLE) AS p_size__sq, CAST(p_size * p_retailprice AS DOUBLE) AS p_size__x__p_retailprice, "
       "p_retailprice * p_retailprice AS p_retailprice__sq FROM part")
def g10(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *G.polynomial2(["p_size", "p_retailprice"]))


_KB = ["l_extendedprice", "l_quantity"]


@query("g11_kbins", "WITH e AS (SELECT " + ", ".join(
    f"quantile_cont({c}, {i / 5}) AS e{i}_{c}" for c in _KB for i in range(1, 5)) + " FROM lineitem) SELECT l_orderkey, l_linenumber, "
    + ", ".join("CAST(" + " + ".join(f"({c} >= e{i}_{c})::INT" for i in range(1, 5)) + f" AS INT) AS {c}" for c in _KB)
    + " FROM lineitem, e")
def g11(spark, sf):
    li = table(spark, sf, "lineitem").select(*_KEY, *_KB)
    return G.apply_kbins(li, G.fit_kbins(li, _KB, 5), _KB)


@query("g12_target_encode", f"""
WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey AS cat, l_quantity AS y, {hsql(42, 'l_orderkey')} % 5 AS fold FROM lineitem),
per AS (SELECT cat, fold, sum(y) AS s, count(*) AS n FROM l GROUP BY 1, 2),
tc AS (SELECT cat, sum(s) AS cs, sum(n) AS cn FROM per GROUP BY 1),
ft AS (SELECT fold, sum(y) AS fs, count(*) AS fn FROM l GROUP BY 1),
tot AS (SELECT sum(y) AS sa, count(*) AS na FROM l),
enc AS (SELECT per.cat, per.fold, (cs - s + 10.0 * ((sa - fs) / (na - fn))) / (cn - n + 10.0) AS te
        FROM per JOIN tc USING (cat) JOIN ft USING (fold), tot)
SELECT l_orderkey, l_linenumber, {r('te')} AS l_suppkey_te FROM l JOIN enc USING (cat, fold)""")
def g12(spark, sf):
    li = H.kfold(table(spark, sf, "lineitem").select(*_KEY, "l_suppkey", "l_quantity"), "l_orderkey", 5, 42)
    out = G.target_encode_oof(li, "l_suppkey", "l_quantity", "fold", 10.0)
    return out.select(*_KEY, r6(F.col("l_suppkey_te")).alias("l_suppkey_te"))


_PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _safe(v):
    return re.sub(r"[^0-9A-Za-z]+", "_", v).strip("_")


@query("g13_one_hot", "SELECT o_orderkey, " + ", ".join(
    f"CAST(o_orderpriority = '{v}' AS INT) AS o_orderpriority_{_safe(v)}" for v in _PRIOS) + " FROM orders")
def g13(spark, sf):
    o = table(spark, sf, "orders")
    cats = G.fit_categories(o, "o_orderpriority")
    return o.select("o_orderkey", *G.one_hot("o_orderpriority", cats))


@query("g13_ordinal", "SELECT o_orderkey, CASE o_orderstatus " + " ".join(
    f"WHEN '{v}' THEN {i}" for i, v in enumerate(["F", "O"])) + " ELSE -1 END AS o_orderstatus_ord FROM orders")
def g13o(spark, sf):
    o = table(spark, sf, "orders")
    # categories fitted on the finished orders' complement: 'P' is unseen → −1
    cats = G.fit_categories(o.where("o_orderstatus <> 'P'"), "o_orderstatus")
    return o.select("o_orderkey", G.ordinal("o_orderstatus", cats))


def _g14_sql():
    cont = ["p_size", "p_retailprice"]
    q = ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in cont)
    steps = [f"WITH m AS (SELECT {q} FROM part)",
             "a AS (SELECT p_partkey, p_type, " + ", ".join(f"coalesce(CAST({c} AS DOUBLE), med_{c}) AS {c}" for c in cont) + " FROM part, m)",
             "b AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in cont) + " FROM a)",
             "c AS (SELECT p_partkey, p_type, " + ", ".join(
                 f"least(greatest({c}, q1_{c} - 1.5 * (q3_{c} - q1_{c})), q3_{c} + 1.5 * (q3_{c} - q1_{c})) AS {c}" for c in cont)
             + " FROM a, b)",
             "s AS (SELECT " + ", ".join(f"avg({c}) AS mu_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS sd_{c}"
                                         for c in cont) + " FROM c)"]
    sel = ("SELECT p_partkey, " + ", ".join(f"{r(f'({c} - mu_{c}) / sd_{c}')} AS {c}" for c in cont) + ", "
           + ", ".join(f"CAST(p_type = '{t}' AS INT) AS p_type_{t}" for t in ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"])
           + " FROM c, s")
    return ", ".join(steps[:1]) + ", " + ", ".join(steps[1:]) + " " + sel


@query("g14_smart_preprocess", _g14_sql())
def g14(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_type")
    types = {r["column_name"]: r["column_type"] for r in column_types(p, skip=["p_partkey"]).collect()}
    out = G.smart_preprocess(p, types, G.preset("default"), keep=["p_partkey"])
    return out.withColumns({c: r6(F.col(c)) for c in ("p_size", "p_retailprice")})


def _g15(spark, sf, name):
    p = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 != 0, F.col("p_size")).alias("p_size"),
                                        F.when(F.col("p_partkey") % 5 != 0, F.col("p_retailprice")).alias("p_retailprice"),
                                        F.when(F.col("p_partkey") % 3 != 0, F.col("p_type")).alias("p_type"))
    types = {"p_size": "continuous", "p_retailprice": "continuous", "p_type": "categorical"}
    out = G.smart_preprocess(p, types, G.preset(name), keep=["p_partkey"])
    return out.withColumns({c: r6(F.col(c)) for c in ("p_size", "p_retailprice")})


def _g15_sql(fill: str) -> str:
    return f"""
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size::DOUBLE END AS p_size, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice::DOUBLE END AS p_retailprice,
  CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS p_type FROM part),
m AS (SELECT p_type AS top FROM p WHERE p_type IS NOT NULL GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 1),
c AS (SELECT DISTINCT p_type AS v FROM p WHERE p_type IS NOT NULL),
o AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM c)
SELECT p_partkey, round(coalesce(p_size, {fill.format('p_size')}), 6) + 0.0 AS p_size, round(coalesce(p_retailprice, {fill.format('p_retailprice')}), 6) + 0.0 AS p_retailprice,
  k::INT AS p_type_ord FROM p, m JOIN o ON o.v = coalesce(p.p_type, m.top)"""


@query("g15_preset_minimal", _g15_sql("0.0"))
def g15m(spark, sf):
    return _g15(spark, sf, "minimal")


@query("g15_preset_tree", _g15_sql("(SELECT quantile_cont({}, 0.5) FROM p)"))
def g15t(spark, sf):
    return _g15(spark, sf, "tree_optimized")


@query("g15_preset_neural")
def g15n(spark, sf):
    return _g15(spark, sf, "neural")


_NOISE_KEY = "l_orderkey || ':' || l_linenumber"


def _noise_sql(c: str, i: int) -> str:
    u, v = hsql(f"42:{i}:r", _NOISE_KEY), hunit_sql(f"42:{i}:a", _NOISE_KEY)
    return f"round({c} + sqrt(-2 * ln(({u} + 1) / 4294967296.0)) * cos(2 * pi() * {v}) * (SELECT stddev_pop({c}) FROM lineitem) * 0.01, 6) + 0.0 AS {c}"


@query("g17_feature_noise", f"SELECT l_orderkey, l_linenumber, {_noise_sql('l_extendedprice', 0)}, {_noise_sql('l_quantity', 1)} FROM lineitem")
def g17(spark, sf):
    li = table(spark, sf, "lineitem").select(*_KEY, "l_extendedprice", "l_quantity")
    out = G.add_feature_noise(li, ["l_extendedprice", "l_quantity"], 0.01, 42, F.concat_ws(":", *_KEY))
    return out.withColumns({c: r6(F.col(c)) for c in ("l_extendedprice", "l_quantity")})


@query("g17_augment_rows", "SELECT p_partkey, CAST(a AS INT) AS augment_id, p_name || '#' || CAST(a AS VARCHAR) AS variant "
       "FROM part, range(1, 4) t(a)")
def g17b(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    out = G.augment_rows(p, 3, F.concat(F.col("p_name"), F.lit("#"), F.col("augment_id").cast("string")))
    return out.select("p_partkey", "augment_id", "variant")


@query("g18_mean_shift", """
WITH s AS (SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1997-01-01'),
ms AS (SELECT avg(l_extendedprice) AS a, avg(l_quantity) AS b FROM s),
mt AS (SELECT avg(l_extendedprice) AS a, avg(l_quantity) AS b FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01')
SELECT l_orderkey, l_linenumber, round(l_extendedprice - ms.a + mt.a, 6) AS l_extendedprice, round(l_quantity - ms.b + mt.b, 6) AS l_quantity
FROM s, ms, mt""")
def g18(spark, sf):
    li = table(spark, sf, "lineitem").select(*_KEY, "l_extendedprice", "l_quantity", "l_shipdate")
    src = li.where("l_shipdate < TIMESTAMP '1997-01-01'")
    tgt = li.where("l_shipdate >= TIMESTAMP '1997-01-01'")
    out = G.mean_shift(src, tgt, ["l_extendedprice", "l_quantity"])
    return out.select(*_KEY, r6(F.col("l_extendedprice")).alias("l_extendedprice"), r6(F.col("l_quantity")).alias("l_quantity"))


def _g03_frame(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.col("p_size").cast("double").alias("f1"), F.length("p_name").cast("double").alias("f2"),
                    F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("p_retailprice"))


@query("g03_knn_impute", """
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS f1, length(p_name)::DOUBLE AS f2,
   CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS t FROM part),
m AS (SELECT * FROM p WHERE t IS NULL), d AS (SELECT * FROM p WHERE t IS NOT NULL),
e AS (SELECT m.p_partkey AS q, d.p_partkey AS did, d.t AS dv, round(sqrt(pow(m.f1 - d.f1, 2) + pow(m.f2 - d.f2, 2)), 9) AS dist FROM m, d),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, did) AS rn FROM e),
f AS (SELECT q, avg(dv) AS fill FROM r WHERE rn <= 5 GROUP BY q)
SELECT p_partkey, round(coalesce(t, fill), 6) + 0.0 AS p_retailprice FROM p LEFT JOIN f ON q = p_partkey""")
def g03(spark, sf):
    from ..operators.preprocess import knn_impute
    out = knn_impute(_g03_frame(spark, sf), "p_partkey", "p_retailprice", ["f1", "f2"], 5)
    return out.select("p_partkey", r6(F.col("p_retailprice")).alias("p_retailprice"))


@query("g03_knn_impute_nan", """
WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size::DOUBLE END AS f1,
   CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE length(p_name)::DOUBLE END AS f2, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE length(p_type)::DOUBLE END AS f3,
   CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_retailprice END AS t FROM part),
m AS (SELECT * FROM p WHERE t IS NULL), d AS (SELECT * FROM p WHERE t IS NOT NULL),
e AS (SELECT m.p_partkey AS q, d.p_partkey AS did, d.t AS dv,
   (m.f1 + d.f1 IS NOT NULL)::INT + (m.f2 + d.f2 IS NOT NULL)::INT + (m.f3 + d.f3 IS NOT NULL)::INT AS common,
   coalesce(pow(m.f1 - d.f1, 2), 0) + coalesce(pow(m.f2 - d.f2, 2), 0) + coalesce(pow(m.f3 - d.f3, 2), 0) AS s FROM m, d),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(sqrt(s * 3 / common), 9), did) AS rn FROM e WHERE common > 0),
f AS (SELECT q, avg(dv) AS fill FROM r WHERE rn <= 5 GROUP BY q)
SELECT p_partkey, round(coalesce(t, fill, (SELECT avg(t) FROM p)), 6) + 0.0 AS p_retailprice FROM p LEFT JOIN f ON q = p_partkey""")
def g03_nan(spark, sf):
    from ..operators.preprocess import knn_impute
    p = table(spark, sf, "part")
    d = p.select("p_partkey", F.when(F.col("p_partkey") % 5 != 0, F.col("p_size")).alias("f1"),
                 F.when(F.col("p_partkey") % 3 != 0, F.length("p_name")).alias("f2"),
                 F.when(F.col("p_partkey") % 11 != 0, F.length("p_type")).alias("f3"),
                 F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("p_retailprice"))
    out = knn_impute(d, "p_partkey", "p_retailprice", ["f1", "f2", "f3"], 5)
    return out.select("p_partkey", r6(F.col("p_retailprice")).alias("p_retailprice"))


@query("g04_iterative_impute")
def g04(spark, sf):
    from ..operators.preprocess import iterative_impute
    d = _g03_frame(spark, sf).withColumn("f1", F.when(F.col("p_partkey") % 5 != 0, F.col("f1")))
    return iterative_impute(d, ["f1", "f2", "p_retailprice"], max_iter=10)
