"""Registered feature-selection queries (I01–I13) on lineitem features.
Missing values are injected deterministically in both engines."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions.columns import r6, round_sig
from ..operators import select as I
from ..operators import wrappers as W
from ..sources.tables import table
from .common import hsql, sig
from .registry import query

FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "price_unit", "ext_dup"]
EXTRA = ["sparse_col", "const_col"]

FEAT_CTE = """fe AS (SELECT l_orderkey, l_linenumber AS line_id, l_returnflag,
   l_extendedprice * (1 - l_discount) / 1000 AS y,
   l_quantity, l_extendedprice,
   CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
   CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_tax END AS l_tax,
   l_linenumber::DOUBLE AS l_linenumber, l_extendedprice / l_quantity AS price_unit, l_extendedprice * 1.01 AS ext_dup,
   CASE WHEN l_orderkey % 3 = 0 THEN l_tax END AS sparse_col, 1.0 AS const_col FROM lineitem)"""


def feats(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey", F.col("l_linenumber").alias("line_id"), "l_returnflag",
        (F.col("l_extendedprice") * (1 - F.col("l_discount")) / 1000).alias("y"),
        "l_quantity", "l_extendedprice",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")).alias("l_discount"),
        F.when(F.col("l_partkey") % 7 != 0, F.col("l_tax")).alias("l_tax"),
        F.col("l_linenumber").cast("double").alias("l_linenumber"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price_unit"),
        (F.col("l_extendedprice") * 1.01).alias("ext_dup"),
        F.when(F.col("l_orderkey") % 3 == 0, F.col("l_tax")).alias("sparse_col"),
        F.lit(1.0).alias("const_col"))


def _key(df):
    return df.withColumn("row_key", F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("line_id").cast("string"),
                                                F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string")))


def _union(parts):
    return "\nUNION ALL ".join(parts)


@query("i01_variance_filter", "WITH " + FEAT_CTE + "\n" + _union(
    [f"SELECT '{c}' AS feature, {sig(f'var_pop({c})')} AS variance, var_pop({c}) > 0.01 AS kept FROM fe" for c in FEATS + EXTRA]))
def i01(spark, sf):
    out = I.variance_scores(feats(spark, sf), FEATS + EXTRA, threshold=0.01)
    return out.withColumn("variance", round_sig(F.col("variance")))


_MED = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in FEATS)
_FILLED = ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in FEATS)


def _corr_drop_sql(cols):
    parts = []
    for j, b in enumerate(cols):
        if j == 0:
            parts.append(f"SELECT '{b}' AS feature, {j} AS pos, NULL::DOUBLE AS m")
        else:
            mx = "greatest(" + ", ".join(f"abs(corr({a}, {b}))" for a in cols[:j]) + ")" if j > 1 else f"abs(corr({cols[0]}, {b}))"
            parts.append(f"SELECT '{b}', {j}, {mx} FROM f")
    return _union(parts)


@query("i02_correlation_drop", f"""WITH {FEAT_CTE},
med AS (SELECT {_MED} FROM fe),
f AS (SELECT {_FILLED} FROM fe, med),
c AS ({_corr_drop_sql(FEATS)})
SELECT feature, CAST(pos AS INT) AS pos, round(m, 6) + 0.0 AS max_abs_corr_earlier, coalesce(m > 0.95, false) AS dropped FROM c""")
def i02(spark, sf):
    out = I.correlation_drop(feats(spark, sf), FEATS, 0.95)
    return out.withColumn("max_abs_corr_earlier", r6(F.col("max_abs_corr_earlier")))


@query("i03_clean_features_plan", "WITH " + FEAT_CTE + "\n" + _union(
    [f"""SELECT '{c}' AS feature, round(avg(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS missing_ratio,
   count(DISTINCT {c}) AS n_distinct, round(quantile_cont({c}, 0.5), 6) + 0.0 AS median,
   avg(CASE WHEN {c} IS NULL OR isnan({c}) THEN 1.0 ELSE 0.0 END) <= 0.5 AND count(DISTINCT {c}) > 1 AS kept FROM fe"""
     for c in FEATS + EXTRA]))
def i03(spark, sf):
    out = I.clean_features_plan(feats(spark, sf), FEATS + EXTRA)
    return out.withColumns({"missing_ratio": r6(F.col("missing_ratio")), "median": r6(F.col("median"))})


@query("i04_target_correlation", "WITH " + FEAT_CTE + ",\ns AS (" + _union(
    [f"SELECT '{c}' AS feature, {i} AS pos, CASE WHEN var_pop({c}) = 0 THEN 0.0 ELSE coalesce(abs(corr({c}, y)), 0.0) END AS score FROM fe" for i, c in enumerate(FEATS + EXTRA)])
       + """),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, pos) AS rank FROM s)
SELECT feature, round(score, 6) + 0.0 AS score, rank, score >= 0.05 AND rank <= 4 AS selected FROM r""")
def i04(spark, sf):
    d = feats(spark, sf)
    out = I.target_correlation(d, FEATS + EXTRA, "y", 0.05, k=4)
    return out.withColumn("score", r6(F.col("score")))


def _mi_sql(cols, bins=10):
    mm = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols + ["y"])

    def b(c):
        return (f"CASE WHEN hi_{c} = lo_{c} THEN 0 ELSE least(CAST(floor(({c} - lo_{c}) / ((hi_{c} - lo_{c}) / {bins})) AS INT), {bins - 1}) END")
    stacked = _union([f"SELECT '{c}' AS feature, {i} AS pos, {b(c)} AS xb, {b('y')} AS yb FROM fe, mm WHERE {c} IS NOT NULL AND y IS NOT NULL"
                      for i, c in enumerate(cols)])
    return f"""mm AS (SELECT {mm} FROM fe),
st AS ({stacked}),
j AS (SELECT feature, pos, xb, yb, count(*) AS nxy FROM st GROUP BY ALL),
nx AS (SELECT feature, xb, sum(nxy) AS nx FROM j GROUP BY ALL),
ny AS (SELECT feature, yb, sum(nxy) AS ny FROM j GROUP BY ALL),
n AS (SELECT feature, sum(nxy) AS n FROM j GROUP BY ALL),
mi AS (SELECT feature, pos, sum(nxy / n * ln(nxy * n / (nx * ny))) AS mi FROM j JOIN nx USING (feature, xb) JOIN ny USING (feature, yb) JOIN n USING (feature) GROUP BY ALL)"""


@query("i05_mutual_info", f"""WITH {FEAT_CTE}, {_mi_sql(FEATS)}
SELECT feature, CAST(pos AS INT) AS pos, round(mi, 6) + 0.0 AS mi, round(mi / (SELECT max(mi) FROM mi), 6) + 0.0 AS score FROM mi""")
def i05(spark, sf):
    out = I.mutual_info(feats(spark, sf), FEATS, "y", 10)
    return out.withColumns({"mi": r6(F.col("mi")), "score": r6(F.col("score"))})


_NMI = ["p_size", "name_len", "p_partkey"]
_PSI = "psi AS (SELECT i AS n, -0.5772156649015329 + coalesce(sum(1.0 / (i - 1)) FILTER (i > 1) OVER (ORDER BY i), 0) AS v FROM range(1, 300001) t(i))"


def _nmi_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, {_NMI.index(c)}::INT AS pos, greatest(0, (SELECT v FROM psi WHERE n = cnt) + (SELECT v FROM psi WHERE n = 3) - mx - my) AS mi FROM (
  SELECT avg(px.v) AS mx, avg(py.v) AS my, any_value(cnt) AS cnt FROM (
    SELECT a.id, any_value(a.cnt) AS cnt, count(*) FILTER (abs(a.{c} - b.{c}) <= greatest(r - 1, 0)) AS nx, count(*) FILTER (abs(a.y - b.y) <= greatest(r - 1, 0)) AS ny
    FROM (SELECT a.id, a.{c}, a.y, any_value(a.cnt) AS cnt, list_sort(list(greatest(abs(a.{c} - b.{c}), abs(a.y - b.y))))[3] AS r
          FROM u a JOIN u b ON a.id <> b.id GROUP BY 1, 2, 3) a, u b GROUP BY a.id) JOIN psi px ON px.n = nx JOIN psi py ON py.n = ny)"""


@query("i05_nearest_mutual_info", f"""
WITH {_PSI},
p AS (SELECT p_partkey AS id, p_size::DOUBLE AS p_size, length(p_name)::DOUBLE AS name_len, p_partkey::DOUBLE AS p_partkey, p_retailprice::DOUBLE AS y FROM part),
s AS (SELECT count(*) AS cnt, stddev_pop(p_size) AS s1, stddev_pop(name_len) AS s2, stddev_pop(p_partkey) AS s3, stddev_pop(y) AS sy FROM p),
u AS (SELECT id, cnt, round(p_size / s1 * 1000000) AS p_size, round(name_len / s2 * 1000000) AS name_len, round(p_partkey / s3 * 1000000) AS p_partkey, round(y / sy * 1000000) AS y FROM p, s),
m AS ({_union([_nmi_sql(c) for c in _NMI])})
SELECT feature, pos, round(mi, 6) + 0.0 AS mi FROM m""")
def i05n(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_size", F.length("p_name").alias("name_len"), "p_partkey",
                                        F.col("p_retailprice").cast("double").alias("y"))
    return I.nearest_mutual_info(p, "id", _NMI, "y").withColumn("mi", r6(F.col("mi")))


def _permuted_sql(keys) -> str:
    steps = ["s0 AS (SELECT id, half, low, n, x >> half AS l, x & low AS r FROM walk)"]
    for i, k in enumerate(keys):
        steps.append(f"t{i} AS (SELECT *, (((r + {k}) & 4294967295)::HUGEINT * {I._MIX[0]} & 4294967295)::BIGINT AS t FROM s{i})")
        steps.append(f"s{i + 1} AS (SELECT id, half, low, n, r AS l, xor(l, (((xor(t, t >> 15))::HUGEINT * {I._MIX[1]} & 4294967295)::BIGINT >> 7) & low) AS r FROM t{i})")
    return ", ".join(steps)


_PERM_KEYS = I.round_keys(7, 0)


@query("i10_permuted_column", f"""
WITH RECURSIVE d AS (SELECT p_partkey AS id, p_retailprice AS v, row_number() OVER (ORDER BY p_partkey) - 1 AS rank, count(*) OVER () AS n FROM part),
b AS (SELECT max(n) AS n, greatest(1, ceil(greatest(1, floor(log2(greatest(max(n) - 1, 1))) + 1) / 2))::INT AS half FROM d),
walk AS (
  SELECT id, rank AS x, d.n, half, (1::BIGINT << half) - 1 AS low, 0 AS step FROM d, b
  UNION ALL
  SELECT id, (l << half) | r, n, half, low, step + 1 FROM (
    WITH w AS (SELECT * FROM walk WHERE step = 0 OR x >= n), {_permuted_sql(_PERM_KEYS).replace("FROM walk", "FROM w").replace("SELECT id, half, low, n,", "SELECT id, step, half, low, n,")}
    SELECT * FROM s{len(_PERM_KEYS)})),
moved AS (SELECT id, x FROM walk WHERE step > 0 AND x < n)
SELECT d.id AS p_partkey, d.v::DOUBLE AS p_retailprice, o.v::DOUBLE AS permuted FROM d JOIN moved m ON m.x = d.rank JOIN d o ON o.id = m.id""")
def i10p(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").cast("double").alias("p_retailprice"))
    out = I.permute_columns(p, "p_partkey", ["p_retailprice"], 7, prefix="__s_")
    return out.select("p_partkey", "p_retailprice", F.col("__s_p_retailprice").alias("permuted"))


@query("i06_f_regression", "WITH " + FEAT_CTE + ",\ns AS (" + _union(
    [f"SELECT '{c}' AS feature, {i} AS pos, count(*) AS n, corr({c}, y) AS r FROM fe" for i, c in enumerate(FEATS)])
       + f""")
SELECT feature, CAST(pos AS INT) AS pos, n, {sig('r * r / (1 - r * r) * (n - 2)', 8)} AS score FROM s""")
def i06(spark, sf):
    out = I.f_regression(feats(spark, sf), FEATS, "y")
    return out.select("feature", "pos", "n", round_sig(F.col("score"), 8).alias("score"))


def _anova_sql(cols, label):
    parts = []
    for i, c in enumerate(cols):
        parts.append(f"""SELECT '{c}' AS feature, {i} AS pos, n, k, ssb, ssw FROM (
  SELECT sum(nk) AS n, count(*) AS k, sum(s * s / nk) - sum(s) * sum(s) / sum(nk) AS ssb, sum(ss) - sum(s * s / nk) AS ssw
  FROM (SELECT {label}, count(*) AS nk, sum({c}) AS s, sum({c} * {c}) AS ss FROM fe GROUP BY {label}))""")
    return _union(parts)


@query("i06_f_classif", f"""WITH {FEAT_CTE}, a AS ({_anova_sql(['l_quantity', 'l_extendedprice', 'l_linenumber', 'price_unit'], 'l_returnflag')})
SELECT feature, CAST(pos AS INT) AS pos, n, round((ssb / (k - 1)) / (ssw / (n - k)), 4) + 0.0 AS score FROM a""")
def i06c(spark, sf):
    out = I.f_classif(feats(spark, sf), ["l_quantity", "l_extendedprice", "l_linenumber", "price_unit"], "l_returnflag")
    return out.select("feature", "pos", "n", (F.round("score", 4) + F.lit(0.0)).alias("score"))


@query("i06_univariate_select")
def i06s(spark, sf):
    d = feats(spark, sf)
    f = I.univariate_select(I.f_regression(d, FEATS, "y"), "fdr", 0.05)
    c = I.univariate_select(I.chi2_classif(d.na.fill(0.0, ["l_discount", "l_tax"]),
                                           ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_returnflag"),
                            "k_best", 2, test="chi2")
    return f.withColumn("test", F.lit("f_fdr")).unionByName(c.withColumn("test", F.lit("chi2_k_best")))


@query("i07_vif_elimination")
def i07(spark, sf):
    return I.vif_elimination(feats(spark, sf), FEATS, 10.0)


@query("i08_mrmr")
def i08(spark, sf):
    return I.mrmr(feats(spark, sf), FEATS, "y", k=4)


@query("i09_boruta")
def i09(spark, sf):
    d = _key(feats(spark, sf)).na.drop(subset=FEATS)
    return I.boruta(d, "row_key", ["l_quantity", "l_discount", "l_tax", "price_unit"], "y", n_iter=3)


@query("i10_permutation_importance")
def i10(spark, sf):
    d = _key(feats(spark, sf))
    return I.permutation_importance(d, "row_key", ["l_quantity", "l_discount", "l_tax", "price_unit"], "y",
                                    n_repeats=2, k=2)


@query("i11_combined_scores")
def i11(spark, sf):
    return I.combined_scores(feats(spark, sf), FEATS, "y")


@query("i12_vote_ensemble")
def i12(spark, sf):
    d = feats(spark, sf)
    s1 = I.variance_scores(d, FEATS, 0.01).where("kept")
    s2 = I.target_correlation(d, FEATS, "y", 0.05, k=4).where("selected")
    s3 = I.mutual_info(d, FEATS, "y").orderBy(F.col("score").desc(), "pos").limit(4)
    s4 = I.correlation_drop(d, FEATS).where("NOT dropped")
    return I.vote([s1, s2, s3, s4], threshold=0.5, k=5)


_WRAP = ["l_quantity", "l_discount", "l_tax", "price_unit"]


def _subset_score_sql(names) -> str:
    """Mean over 5 folds of the held-out R² of least squares on one or two columns."""
    a, b = names[0], names[-1]
    terms = {"n": "1", "x": a, "z": b, "y": "y", "xx": f"{a} * {a}", "zz": f"{b} * {b}", "xz": f"{a} * {b}", "xy": f"{a} * y", "zy": f"{b} * y", "yy": "y * y"}
    fold = ", ".join(f"sum({v}) AS {k}" for k, v in terms.items())
    tr = ", ".join(f"sum({k}) OVER () - {k} AS t{k}" for k in terms)
    cov = {k: f"(t{k} - t{k[0]} * t{k[1]} / tn)" for k in ("xx", "zz", "xz", "xy", "zy")}
    if a == b:
        slopes = f"{cov['xy']} / {cov['xx']} AS bx, 0.0 AS bz"
    else:
        det = f"({cov['xx']} * {cov['zz']} - {cov['xz']} * {cov['xz']})"
        slopes = (f"({cov['xy']} * {cov['zz']} - {cov['zy']} * {cov['xz']}) / {det} AS bx, "
                  f"({cov['zy']} * {cov['xx']} - {cov['xy']} * {cov['xz']}) / {det} AS bz")
    return (f"SELECT {len(names)} AS size, {list(names)!r} AS features, avg(1 - (yy - 2 * (c * y + bx * xy + bz * zy) + n * c * c + bx * bx * xx + bz * bz * zz "
            f"+ 2 * (c * bx * x + c * bz * z + bx * bz * xz)) / (yy - y * y / n)) AS score FROM (SELECT *, (ty - bx * tx - bz * tz) / tn AS c FROM ("
            f"SELECT *, {slopes} FROM (SELECT *, {tr} FROM (SELECT {fold} FROM w GROUP BY fold))))")


_WRAP_CTE = (f"WITH {FEAT_CTE}, w AS (SELECT {hsql(42, 'l_orderkey * 8 + line_id')} % 5 AS fold, y, " + ", ".join(_WRAP) + " FROM fe WHERE "
             + " AND ".join(f"{c} IS NOT NULL" for c in _WRAP) + "), sc AS ("
             + _union([_subset_score_sql(s) for k in (1, 2) for s in itertools.combinations(_WRAP, k)]) + "), ")


def _wrap(spark, sf):
    return feats(spark, sf).withColumn("row_no", F.col("l_orderkey") * 8 + F.col("line_id"))


@query("i13_exhaustive_selection", _WRAP_CTE + """b AS (SELECT *, row_number() OVER (PARTITION BY size ORDER BY round(score, 9) DESC, features) AS r FROM sc)
SELECT size, features, round(score, 6) + 0.0 AS score, row_number() OVER (ORDER BY round(score, 9) DESC, size) = 1 AS selected FROM b WHERE r = 1""")
def i13e(spark, sf):
    return W.select_features(_wrap(spark, sf), "row_no", _WRAP, "y", "efs", k=2).withColumn("score", r6(F.col("score")))


_FORWARD = _WRAP_CTE + """one AS (SELECT * FROM sc WHERE size = 1 ORDER BY round(score, 9) DESC, features LIMIT 1),
two AS (SELECT sc.* FROM sc, one WHERE sc.size = 2 AND list_contains(sc.features, one.features[1]) ORDER BY round(sc.score, 9) DESC, sc.features LIMIT 1)
SELECT size, features, round(score, 6) + 0.0 AS score, size = 2 AS selected FROM (FROM one UNION ALL FROM two)"""


@query("i13_sequential_forward", _FORWARD)
def i13s(spark, sf):
    return W.select_features(_wrap(spark, sf), "row_no", _WRAP, "y", "sfs", k=2).withColumn("score", r6(F.col("score")))


@query("i13_floating_forward", _FORWARD)  # with two columns nothing floats out
def i13f(spark, sf):
    return W.select_features(_wrap(spark, sf), "row_no", _WRAP, "y", "sffs", k=2).withColumn("score", r6(F.col("score")))


@query("i13_floating_backward")
def i13b(spark, sf):
    return W.select_features(_wrap(spark, sf), "row_no", FEATS, "y", "sbfs", k=3).withColumn("score", r6(F.col("score")))


@query("i13_rfe", "WITH " + FEAT_CTE + """, w AS (SELECT l_quantity AS x, price_unit AS z, y FROM fe),
b AS (SELECT (covar_pop(x, y) * var_pop(z) - covar_pop(z, y) * covar_pop(x, z)) / (var_pop(x) * var_pop(z) - covar_pop(x, z) ** 2) AS bx,
  (covar_pop(z, y) * var_pop(x) - covar_pop(x, y) * covar_pop(x, z)) / (var_pop(x) * var_pop(z) - covar_pop(x, z) ** 2) AS bz FROM w)
SELECT 'l_quantity' AS feature, CASE WHEN abs(bx) >= abs(bz) THEN 1 ELSE 2 END AS ranking, abs(bx) >= abs(bz) AS selected FROM b
UNION ALL SELECT 'price_unit', CASE WHEN abs(bx) < abs(bz) THEN 1 ELSE 2 END, abs(bx) < abs(bz) FROM b""")
def i13r(spark, sf):
    return W.recursive_elimination(_wrap(spark, sf), "row_no", ["l_quantity", "price_unit"], "y", k=1)


@query("i13_rfecv")
def i13rcv(spark, sf):
    return W.recursive_elimination(_wrap(spark, sf), "row_no", FEATS, "y", folds=5)


@query("i13_forward_selection")
def i13(spark, sf):
    d = _key(feats(spark, sf))
    return I.sequential_selection(d, "row_key", ["l_quantity", "l_discount", "l_tax", "price_unit", "l_linenumber"],
                                  "y", k=3, direction="forward")
