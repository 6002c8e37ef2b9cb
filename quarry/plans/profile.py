"""Registered profiling, aggregation and window queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import profile as P
from ..sources.tables import table
from .registry import query


@query("f01_group_top", "SELECT p_type AS group_key, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, group_key LIMIT 10")
def f01(spark, sf):
    return P.group_frequency(table(spark, sf, "part"), "p_type")[0]


@query("f01_group_summary", """
SELECT sum(n) AS total, count(*) AS n_unique, round(count(*) / sum(n), 6) AS diversity, round(max(n) / sum(n), 6) AS top_share
FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)""")
def f01b(spark, sf):
    s = P.group_frequency(table(spark, sf, "part"), "p_brand")[1]
    return s.withColumn("diversity", r6(F.col("diversity"))).withColumn("top_share", r6(F.col("top_share")))


_CATS = [("license", "(?i)licen[cs]e"), ("contact", "[A-Za-z0-9._%+-]+@"),
         ("network", r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"), ("junk", "[*#%]{3,}")]


@query("f02_first_match_category", "SELECT CASE " + " ".join(
    f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in _CATS) + " ELSE 'other' END AS category, count(*) AS n "
    "FROM documents GROUP BY 1")
def f02(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupBy(P.first_match_category(F.col("text"), _CATS).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("f03_diversity_notes", """
WITH s AS (SELECT count(*) / sum(n) AS d, max(n) / sum(n) AS t FROM (SELECT p_size, count(*) AS n FROM part GROUP BY 1))
SELECT list_filter([CASE WHEN d < 0.1 THEN 'very_low_diversity' WHEN d < 0.3 THEN 'low_diversity'
  WHEN d > 0.7 THEN 'high_diversity' END, CASE WHEN t > 0.3 THEN 'dominant_group' END], lambda x: x IS NOT NULL) AS notes FROM s""")
def f03(spark, sf):
    return P.diversity_notes(P.group_frequency(table(spark, sf, "part"), "p_size")[1])


_F04_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _f04_sql_aggs():
    out = []
    for c in _F04_COLS:
        v = f"CASE WHEN l_returnflag <> 'R' THEN {c} END"
        out += [f"round(avg({v}), 6) AS {c}_mean", f"round(stddev_pop({v}), 6) AS {c}_std",
                f"CAST(min({v}) AS DOUBLE) AS {c}_min", f"CAST(max({v}) AS DOUBLE) AS {c}_max"]
    return ", ".join(out)


@query("f04_dataset_profile", "SELECT count_if(l_returnflag <> 'R') AS n_valid, count_if(NOT (l_returnflag <> 'R')) AS n_invalid, "
       + _f04_sql_aggs() + " FROM lineitem")
def f04(spark, sf):
    prof = P.dataset_profile(table(spark, sf, "lineitem"), _F04_COLS, F.col("l_returnflag") != "R")
    return prof.withColumns({c: r6(F.col(c)) for c in prof.columns if c.endswith("_mean") or c.endswith("_std")})


_PATS = [("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+"), ("license", "(?i)licen[cs]e"), ("question", r"\?"),
         ("english_article", "(?i)\\bthe\\b"), ("newline", "\n")]


@query("f05_pattern_prevalence", " UNION ALL ".join(
    f"SELECT '{n}' AS pattern, round(avg(CASE WHEN regexp_matches(text, '{p}') THEN 1.0 ELSE 0.0 END), 6) AS prevalence, "
    f"avg(CASE WHEN regexp_matches(text, '{p}') THEN 1.0 ELSE 0.0 END) >= 0.3 AS is_dominant FROM documents" for n, p in _PATS))
def f05(spark, sf):
    out = P.pattern_prevalence(table(spark, sf, "documents"), "text", _PATS)
    return out.withColumn("prevalence", r6(F.col("prevalence")))


@query("f06_profile_recommendations", """
WITH p AS (SELECT avg(l_quantity) AS q, max(l_extendedprice) / min(l_extendedprice) AS pr, avg(l_discount) AS d FROM lineitem),
a AS (SELECT list_filter([CASE WHEN q > 25 THEN 'large_quantities' END, CASE WHEN pr > 100 THEN 'wide_price_range' END,
  CASE WHEN d > 0.05 THEN 'discount_heavy' END], lambda x: x IS NOT NULL) AS r FROM p)
SELECT CASE WHEN len(r) = 0 THEN ['general'] ELSE r END AS recommendations FROM a""")
def f06(spark, sf):
    prof = P.dataset_profile(table(spark, sf, "lineitem"), _F04_COLS)
    rules = [("large_quantities", F.col("l_quantity_mean") > 25),
             ("wide_price_range", F.col("l_extendedprice_max") / F.col("l_extendedprice_min") > 100),
             ("discount_heavy", F.col("l_discount_mean") > 0.05)]
    return P.profile_recommendations(prof, rules)


@query("f07_mixture_aggregate", """
WITH j AS (SELECT l_orderkey, CAST(l_quantity AS DECIMAL(15, 2)) AS r, p_size, CAST(p_retailprice AS DECIMAL(15, 2)) AS p_retailprice
  FROM lineitem JOIN part ON l_partkey = p_partkey),
s AS (SELECT l_orderkey, sum(r) AS tot, count(*) AS n_components, max(r) AS mx, min(r) AS mn, stddev_pop(r) AS sd,
  sum(r * p_size) AS w1, sum(r * p_retailprice) AS w2, stddev_pop(p_size) AS s1, stddev_pop(p_retailprice) AS s2 FROM j GROUP BY 1),
t AS (SELECT *, CASE WHEN tot = 0 THEN 1.0 ELSE tot END AS nm FROM s)
SELECT l_orderkey, n_components, round(mx / nm, 6) AS max_ratio, round(mn / nm, 6) AS min_ratio, round(sd / nm, 6) AS std_ratio,
  round(w1 / nm, 6) AS p_size_weighted, round(w2 / nm, 6) AS p_retailprice_weighted,
  round(CASE WHEN n_components > 1 THEN s1 ELSE 0.0 END, 6) AS p_size_std,
  round(CASE WHEN n_components > 1 THEN s2 ELSE 0.0 END, 6) AS p_retailprice_std FROM t""")
def f07(spark, sf):
    # exact (decimal) weighted sums: the result is independent of summation order
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.col("l_quantity").cast("decimal(15,2)").alias("l_quantity"))
    pt = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_retailprice").cast("decimal(15,2)").alias("p_retailprice"))
    out = P.mixture_aggregate(li, "l_orderkey", "l_partkey", "l_quantity", pt, "p_partkey",
                              ["p_size", "p_retailprice"])
    return out.select("l_orderkey", "n_components", *[r6(F.col(c)).alias(c) for c in out.columns[2:]])


@query("f08_mixture_wide", """
WITH w AS (SELECT l_orderkey, max(CASE WHEN l_linenumber = 1 THEN l_partkey END) AS k1, max(CASE WHEN l_linenumber = 1 THEN l_quantity / 100 END) AS r1,
  max(CASE WHEN l_linenumber = 2 THEN l_partkey END) AS k2, max(CASE WHEN l_linenumber = 2 THEN l_quantity / 100 END) AS r2,
  max(CASE WHEN l_linenumber = 3 THEN l_partkey END) AS k3, max(CASE WHEN l_linenumber = 3 THEN l_quantity / 100 END) AS r3
  FROM lineitem GROUP BY l_orderkey),
lg AS (SELECT l_orderkey, coalesce(k1, 0) AS k, coalesce(r1, 0.0) AS r FROM w UNION ALL
       SELECT l_orderkey, coalesce(k2, 0), coalesce(r2, 0.0) FROM w UNION ALL SELECT l_orderkey, coalesce(k3, 0), coalesce(r3, 0.0) FROM w)
SELECT l_orderkey, round(sum(r * p_size), 6) AS p_size_mix, round(sum(r * p_retailprice), 6) AS p_retailprice_mix
FROM lg JOIN part ON k = p_partkey GROUP BY l_orderkey""")
def f08(spark, sf):
    li = table(spark, sf, "lineitem")
    wide = li.groupBy("l_orderkey").agg(
        *[F.max(F.when(F.col("l_linenumber") == i, F.col("l_partkey"))).alias(f"k{i}") for i in (1, 2, 3)],
        *[F.max(F.when(F.col("l_linenumber") == i, F.col("l_quantity") / 100)).alias(f"r{i}") for i in (1, 2, 3)])
    out = P.mixture_wide(wide, "l_orderkey", [("k1", "r1"), ("k2", "r2"), ("k3", "r3")], table(spark, sf, "part"),
                         "p_partkey", ["p_size", "p_retailprice"], default_key=0)
    return out.select("l_orderkey", *[r6(F.col(c)).alias(c) for c in out.columns[1:]])


@query("f09_cluster_stats", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT label, 'e{i}' AS feature, count(embedding[{i + 1}]) AS size, round(avg(CAST(embedding[{i + 1}] AS DOUBLE)), 6) AS mean, "
    f"round(stddev_samp(CAST(embedding[{i + 1}] AS DOUBLE)), 6) AS std FROM embeddings GROUP BY label" for i in range(4)) + ")")
def f09(spark, sf):
    e = table(spark, sf, "embeddings").select("label", *[F.col("embedding")[i].alias(f"e{i}") for i in range(4)])
    out = P.cluster_stats(e, "label", [f"e{i}" for i in range(4)])
    return out.withColumn("mean", r6(F.col("mean"))).withColumn("std", r6(F.col("std")))


@query("f10_correlation_pearson", " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM lineitem"
    for a in _F04_COLS for b in _F04_COLS))
def f10(spark, sf):
    out = P.correlation_matrix(table(spark, sf, "lineitem"), _F04_COLS)
    return out.withColumn("corr", r6(F.col("corr")))


_SP = ["l_quantity", "l_extendedprice", "l_discount"]


@query("f10_correlation_spearman", "WITH rk AS (SELECT " + ", ".join(
    f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _SP)
    + " FROM lineitem) " + " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr({a}, {b}), 6) AS corr FROM rk" for a in _SP for b in _SP))
def f10b(spark, sf):
    li = table(spark, sf, "lineitem")
    out = P.correlation_matrix(li, _SP, "spearman", ["l_orderkey", "l_linenumber"])
    return out.withColumn("corr", r6(F.col("corr")))


_KT = ["p_size", "p_retailprice", "name_len"]


def _kendall_sql(a: str, b: str) -> str:
    return (f"SELECT '{a}' AS col_a, '{b}' AS col_b, (SELECT sum(l.w * r.w * sign(l.{a} - r.{a}) * sign(l.{b} - r.{b})) / "
            f"(sqrt(sum(l.w * r.w * abs(sign(l.{a} - r.{a})))) * sqrt(sum(l.w * r.w * abs(sign(l.{b} - r.{b}))))) "
            f"FROM (SELECT {a}, {b}, count(*)::DOUBLE AS w FROM p GROUP BY 1, 2) l, (SELECT {a}, {b}, count(*)::DOUBLE AS w FROM p GROUP BY 1, 2) r) AS corr")


@query("f10_correlation_kendall", "WITH p AS (SELECT p_size::DOUBLE AS p_size, p_retailprice::DOUBLE AS p_retailprice, length(p_name)::DOUBLE AS name_len FROM part), k AS ("
       + " UNION ALL ".join(_kendall_sql(a, b) for a in _KT for b in _KT) + ") SELECT col_a, col_b, round(corr, 6) + 0.0 AS corr FROM k")
def f10c(spark, sf):
    p = table(spark, sf, "part").select("p_size", "p_retailprice", F.length("p_name").alias("name_len"))
    return P.correlation_matrix(p, _KT, "kendall").withColumn("corr", r6(F.col("corr")))


@query("f11_histograms", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((CAST({c} AS DOUBLE) - lo) / (hi - lo) * 10), 9) END AS INT) AS bin, "
    f"count(*) AS n FROM lineitem, (SELECT CAST(min({c}) AS DOUBLE) AS lo, CAST(max({c}) AS DOUBLE) AS hi FROM lineitem) GROUP BY 1, 2"
    for c in _F04_COLS))
def f11(spark, sf):
    return P.histograms(table(spark, sf, "lineitem"), _F04_COLS, 10)


def _metrics_long(spark, sf):
    o = table(spark, sf, "orders")
    m = o.groupBy(F.col("o_orderpriority").alias("run")).agg(
        F.round(F.avg("o_totalprice") / 1e6, 6).alias("r2"), F.round(F.stddev_pop("o_totalprice") / 1e5, 6).alias("rmse"),
        F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("accuracy"))
    return m.select("run", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value"))
                                            for c in ("accuracy", "r2", "rmse")])))


@query("f12_leaderboard", """
WITH m AS (SELECT o_orderpriority AS run, round(avg(o_totalprice) / 1e6, 6) AS r2, round(stddev_pop(o_totalprice) / 1e5, 6) AS rmse,
  round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM orders GROUP BY 1)
SELECT run, accuracy, r2, rmse, coalesce(r2, accuracy, 0.0) AS best_score,
  CAST(rank() OVER (ORDER BY coalesce(r2, 0.0) DESC, run) AS INT) AS rank FROM m""")
def f12(spark, sf):
    return P.leaderboard(_metrics_long(spark, sf), "run", "metric", "value", "r2")


@query("f13_timing_report", """
SELECT event_type, round(sum(value), 4) AS total, count(*) AS calls, round(avg(value), 6) AS avg,
  round(sum(value) / sum(sum(value)) OVER (), 6) AS share FROM events GROUP BY 1""")
def f13(spark, sf):
    out = P.timing_report(table(spark, sf, "events"), "event_type", "value")
    return out.select("event_type", r6(F.col("total"), 4).alias("total"), "calls", r6(F.col("avg")).alias("avg"),
                      r6(F.col("share")).alias("share"))


@query("w01_top_k_per_group", """
SELECT doc_id, lang, n_chars, rank FROM (SELECT doc_id, lang, n_chars,
  CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents) WHERE rank <= 3""")
def w01(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return P.top_k_per_group(d, "lang", "n_chars", 3, "doc_id")


@query("w02_components_for_variance", """
WITH v AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS c,
  unnest([var_pop(l_quantity), var_pop(l_extendedprice / 1000), var_pop(l_discount * 100), var_pop(l_tax * 100)]) AS var FROM lineitem),
i AS (SELECT var, row_number() OVER (ORDER BY var DESC, c) - 1 AS idx FROM v),
c AS (SELECT idx, sum(var) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(var) OVER () AS cs FROM i)
SELECT CAST(min(idx) + 1 AS INT) AS n_components FROM c WHERE cs >= 0.95""")
def w02(spark, sf):
    from pyspark.sql import Window as W
    li = table(spark, sf, "lineitem")
    one = li.agg(F.var_pop("l_quantity").alias("l_quantity"), F.var_pop(F.col("l_extendedprice") / 1000).alias("l_extendedprice"),
                 F.var_pop(F.col("l_discount") * 100).alias("l_discount"), F.var_pop(F.col("l_tax") * 100).alias("l_tax"))
    v = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("var")) for c in _F04_COLS])))
    v = v.withColumn("idx", F.row_number().over(W.orderBy(F.desc("var"), "c")) - 1)
    return P.components_for_variance(v, "idx", "var", 0.95).select(F.col("n_components").cast("int"))


@query("w03_set_ops", """
WITH a AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
b AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
SELECT (SELECT count(*) FROM (SELECT * FROM a UNION ALL SELECT * FROM b)) AS union_rows,
  (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS a_minus_b,
  (SELECT count(*) FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)) AS a_anti_b""")
def w03(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    a = o.where("o_orderdate < TIMESTAMP '1997-01-01'").drop("o_orderdate")
    b = o.where("o_orderdate >= TIMESTAMP '1996-01-01'").drop("o_orderdate")
    from ..functions.bind import bind_stats
    u = P.union_rows(a, b).agg(F.count(F.lit(1)).alias("union_rows"))
    e = a.exceptAll(b).agg(F.count(F.lit(1)).alias("a_minus_b"))
    r = P.remaining(a, b, "o_orderkey").agg(F.count(F.lit(1)).alias("a_anti_b"))
    x = bind_stats(bind_stats(u, e, "_e"), r, "_r")
    return x.select("union_rows", F.col("_e.a_minus_b").alias("a_minus_b"), F.col("_r.a_anti_b").alias("a_anti_b"))


@query("w04_best_so_far", """
SELECT o_orderkey, min(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best_so_far FROM orders""")
def w04(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.best_so_far(o, "o_orderkey", "o_totalprice").select("o_orderkey", "best_so_far")
