"""Registered data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import quality as Q
from ..sources.tables import table
from .common import (LI_NULL_CTE, LINEITEM_COLS, LINEITEM_NUM, LINEITEM_TYPES,
                     lineitem_nulls, r)
from .registry import query

_DOUBLE = {c for c, t in LINEITEM_TYPES.items() if t == "double"}


def _miss_sql(c: str) -> str:
    return f"({c} IS NULL OR isnan({c}))" if c in _DOUBLE else f"({c} IS NULL)"


def _missing_long_sql(extra_dtype: bool) -> str:
    aggs = ", ".join(f"count_if({_miss_sql(c)}) AS m_{c}" for c in LINEITEM_COLS)
    parts = []
    for c in LINEITEM_COLS:
        dt = f", '{LINEITEM_TYPES[c]}' AS dtype" if extra_dtype else ""
        parts.append(f"SELECT '{c}' AS column_name, CAST(m_{c} AS BIGINT) AS missing_count, "
                     f"{r(f'CASE WHEN n > 0 THEN m_{c} / n ELSE 0.0 END')} AS missing_rate{dt} FROM m")
    return (f"WITH {LI_NULL_CTE}, m AS (SELECT count(*) AS n, {aggs} FROM li) "
            f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE missing_count > 0")


@query("c01_missing_profile", _missing_long_sql(False))
def c01(spark, sf):
    return Q.missing_profile(lineitem_nulls(spark, sf)).withColumn("missing_rate", r6(F.col("missing_rate")))


@query("c02_missing_summary", _missing_long_sql(True))
def c02(spark, sf):
    return Q.missing_summary(lineitem_nulls(spark, sf)).withColumn("missing_rate", r6(F.col("missing_rate")))


@query("c03_duplicate_rows", f"""
SELECT CAST(sum(c) AS BIGINT) AS n_rows, CAST(sum(c - 1) AS BIGINT) AS duplicate_rows,
       {r('sum(c - 1) / sum(c)')} AS duplicate_percent
FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang)""")
def c03(spark, sf):
    return Q.duplicate_rows(table(spark, sf, "documents"), ["text", "lang"]).withColumn(
        "duplicate_percent", r6(F.col("duplicate_percent")))


@query("c04_duplicate_keys", """
SELECT CAST(count_if(c > 1) AS BIGINT) AS duplicate_keys,
       CAST(coalesce(sum(CASE WHEN c > 1 THEN c - 1 END), 0) AS BIGINT) AS duplicate_occurrences
FROM (SELECT count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY text)""")
def c04(spark, sf):
    return Q.duplicate_keys(table(spark, sf, "documents"), "text")


def _iqr_sql(t: float) -> str:
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}"
                   for c in LINEITEM_NUM)
    parts = [f"SELECT '{c}' AS column_name, CAST(count_if({c} < q1_{c} - {t} * (q3_{c} - q1_{c}) OR "
             f"{c} > q3_{c} + {t} * (q3_{c} - q1_{c})) AS BIGINT) AS outlier_count FROM li, b"
             for c in LINEITEM_NUM]
    return f"WITH {LI_NULL_CTE}, b AS (SELECT {qs} FROM li) " + " UNION ALL ".join(parts)


@query("c05_outliers_iqr", _iqr_sql(1.5))
def c05(spark, sf):
    return Q.outliers_iqr(lineitem_nulls(spark, sf), LINEITEM_NUM, 1.5)


def _z_sql(t: float) -> str:
    st = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LINEITEM_NUM)
    parts = [f"SELECT '{c}' AS column_name, CAST(count_if(s_{c} > 0 AND abs({c} - m_{c}) / s_{c} > {t}) "
             f"AS BIGINT) AS outlier_count FROM li, s" for c in LINEITEM_NUM]
    return f"WITH {LI_NULL_CTE}, s AS (SELECT {st} FROM li) " + " UNION ALL ".join(parts)


@query("c06_outliers_zscore", _z_sql(2.0))
def c06(spark, sf):
    return Q.outliers_zscore(lineitem_nulls(spark, sf), LINEITEM_NUM, 2.0)


_C07_COLS = LINEITEM_COLS + ["k_const", "k_null"]


@query("c07_constant_columns", "WITH " + LI_NULL_CTE + ", t AS (SELECT *, 1 AS k_const, "
       "CAST(NULL AS DOUBLE) AS k_null FROM li) " + " UNION ALL ".join(
           f"SELECT '{c}' AS column_name FROM t HAVING min({c}) IS NOT DISTINCT FROM max({c})"
           for c in _C07_COLS))
def c07(spark, sf):
    df = lineitem_nulls(spark, sf).withColumn("k_const", F.lit(1)).withColumn(
        "k_null", F.lit(None).cast("double"))
    return Q.constant_columns(df, _C07_COLS)


_C08_COLS = LINEITEM_NUM + ["l_price2"]


def _c08_sql() -> str:
    pairs = [(a, b) for i, a in enumerate(_C08_COLS) for b in _C08_COLS[i + 1:]]
    parts = [f"SELECT '{a}' AS col_a, '{b}' AS col_b, abs(corr({a}, {b})) AS abs_corr FROM t"
             for a, b in pairs]
    return (f"WITH {LI_NULL_CTE}, t AS (SELECT *, l_extendedprice * 2 + 1 AS l_price2 FROM li) "
            f"SELECT col_a, col_b, {r('abs_corr')} AS abs_corr FROM ({' UNION ALL '.join(parts)}) "
            f"WHERE abs_corr > 0.95")


@query("c08_high_correlation", _c08_sql())
def c08(spark, sf):
    df = lineitem_nulls(spark, sf).withColumn("l_price2", F.col("l_extendedprice") * 2 + 1)
    return Q.high_correlation(df, _C08_COLS, 0.95).withColumn("abs_corr", r6(F.col("abs_corr")))


def _scorecard_sql() -> str:
    num = LINEITEM_NUM
    cols = LINEITEM_COLS
    pairs = [(a, b) for i, a in enumerate(num) for b in num[i + 1:]]
    miss = " + ".join(f"count_if({_miss_sql(c)})" for c in cols)
    hi_miss = " + ".join(f"(CASE WHEN count_if({_miss_sql(c)}) > count(*) * 0.5 THEN 1 ELSE 0 END)"
                         for c in cols)
    const = " + ".join(f"(CASE WHEN min({c}) IS NOT DISTINCT FROM max({c}) THEN 1 ELSE 0 END)" for c in cols)
    corr = " + ".join(f"(CASE WHEN abs(corr({a}, {b})) > 0.95 THEN 1 ELSE 0 END)" for a, b in pairs)
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in num)
    outl = " + ".join(f"count_if({c} < q1_{c} - 1.5 * (q3_{c} - q1_{c}) OR {c} > q3_{c} + 1.5 * (q3_{c} - q1_{c}))"
                      for c in num)
    nf, nn = len(cols), len(num)
    return f"""
WITH {LI_NULL_CTE},
prof AS (SELECT count(*) AS n_samples, CAST({miss} AS BIGINT) AS missing_count,
                CAST({const} AS BIGINT) AS constant_columns, CAST({corr} AS BIGINT) AS correlated_pairs,
                CAST({hi_miss} AS BIGINT) AS high_missing_columns FROM li),
dup AS (SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS duplicate_rows FROM
        (SELECT count(*) AS c FROM li GROUP BY {', '.join(cols)})),
b AS (SELECT {qs} FROM li),
o AS (SELECT CAST({outl} AS BIGINT) AS outlier_count FROM li, b),
s AS (SELECT *, {nf} AS n_features,
        CASE WHEN n_samples > 0 THEN missing_count / (n_samples * {nf}) ELSE 0.0 END AS missing_percent,
        CASE WHEN n_samples > 0 THEN duplicate_rows / n_samples ELSE 0.0 END AS duplicate_percent,
        CASE WHEN n_samples > 0 THEN outlier_count / (n_samples * {nn}) ELSE 0.0 END AS outlier_percent
      FROM prof, dup, o),
f AS (SELECT *, greatest(0.0, least(100.0, 100.0 - (missing_percent * 50 + duplicate_percent * 30
         + outlier_percent * 20 + constant_columns / {nf} * 10))) AS overall_score,
         list_filter([CASE WHEN high_missing_columns > 0 THEN 'drop_high_missing_columns' END,
                      CASE WHEN duplicate_percent > 0.01 THEN 'drop_duplicates' END,
                      CASE WHEN constant_columns > 0 THEN 'drop_constant_columns' END,
                      CASE WHEN correlated_pairs > 0 THEN 'reduce_correlated_pairs' END],
                     lambda x: x IS NOT NULL) AS recs FROM s)
SELECT n_samples, n_features, missing_count, {r('missing_percent')} AS missing_percent,
       constant_columns, correlated_pairs, high_missing_columns, duplicate_rows,
       {r('duplicate_percent')} AS duplicate_percent, outlier_count, {r('outlier_percent')} AS outlier_percent,
       {r('overall_score')} AS overall_score,
       CASE WHEN len(recs) = 0 THEN ['quality_good'] ELSE recs END AS recommendations
FROM f"""


def scorecard(spark, sf):
    rep = Q.quality_report(lineitem_nulls(spark, sf))
    return rep.withColumns({c: r6(F.col(c)) for c in
                            ("missing_percent", "duplicate_percent", "outlier_percent", "overall_score")})


query("c09_quality_report", _scorecard_sql())(scorecard)


@query("c11_recommendations", "SELECT unnest(recommendations) AS recommendation FROM ("
       + _scorecard_sql() + ")")
def c11(spark, sf):
    return scorecard(spark, sf).select(F.explode("recommendations").alias("recommendation"))


_VALID_SQL = "length(trim(text)) > 0 AND n_chars > 0"


@query("c10_quality_score_b", f"""
WITH d AS (SELECT * FROM documents), v AS (SELECT * FROM d WHERE {_VALID_SQL}),
dk AS (SELECT coalesce(sum(c - 1), 0) AS dups FROM (SELECT count(*) AS c FROM v GROUP BY text)),
b AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM v),
o AS (SELECT count_if(n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1)) AS outl FROM v, b),
n AS (SELECT (SELECT count(*) FROM d) AS n_total, (SELECT count(*) FROM v) AS n_valid)
SELECT n_total, n_valid, {r('n_valid / n_total')} AS validity,
       {r('dups / n_valid')} AS duplicate_ratio, {r('outl / n_valid')} AS outlier_ratio,
       {r('greatest(0.0, 100.0 - (1 - n_valid / n_total) * 30 - dups / n_valid * 20 - outl / n_valid * 10)')} AS quality_score
FROM n, dk, o""")
def c10(spark, sf):
    d = table(spark, sf, "documents")
    valid = (F.length(F.trim("text")) > 0) & (F.col("n_chars") > 0)
    tot = d.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(valid).alias("n_valid"))
    v = d.where(valid)
    dk = Q.duplicate_keys(v, "text").select(F.col("duplicate_occurrences").alias("dups"))
    o = Q.outliers_iqr(v, ["n_chars"]).select(F.col("outlier_count").alias("outl"))
    from ..functions.bind import bind_stats
    row = bind_stats(bind_stats(tot, dk, "_d"), o, "_o")
    val = F.col("n_valid") / F.col("n_total")
    dr = F.col("_d.dups") / F.col("n_valid")
    orr = F.col("_o.outl") / F.col("n_valid")
    return row.select("n_total", "n_valid", r6(val).alias("validity"), r6(dr).alias("duplicate_ratio"),
                      r6(orr).alias("outlier_ratio"), r6(Q.quality_score_b(val, dr, orr)).alias("quality_score"))


@query("c12_clean_rows", f"""
WITH v AS (SELECT * FROM documents WHERE {_VALID_SQL}),
b AS (SELECT quantile_cont(n_chars, 0.25) AS q1, quantile_cont(n_chars, 0.75) AS q3 FROM documents),
f AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents)
SELECT doc_id, n_chars FROM f, b
WHERE rn = 1 AND {_VALID_SQL}
  AND NOT (n_chars < q1 - 1.5 * (q3 - q1) OR n_chars > q3 + 1.5 * (q3 - q1))""")
def c12(spark, sf):
    d = table(spark, sf, "documents")
    valid = (F.length(F.trim("text")) > 0) & (F.col("n_chars") > 0)
    return Q.clean_rows(d, "text", "doc_id", valid, True, "n_chars", True).select("doc_id", "n_chars")
