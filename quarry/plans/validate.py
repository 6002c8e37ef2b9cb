"""Registered detection / validation / rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.bind import bind_stats
from ..functions.columns import r6
from ..operators import rules as R
from ..operators import validate as V
from ..sources.tables import table
from .common import inject_nulls, inject_nulls_sql, r
from .registry import query

_KEY_RE = V.alphabet_regex()


def _all_keys_sql(col: str, tbl: str) -> str:
    return f"(SELECT coalesce(bool_and(regexp_matches({col}, '{_KEY_RE}')), false) FROM {tbl})"


_PART_CODE = "part_c AS (SELECT *, 'C' || CAST(p_size AS VARCHAR) || 'N' AS code FROM part)"


@query("b01_key_column_scores", f"WITH {_PART_CODE} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i} AS position, {_all_keys_sql(c, 'part_c')} AS looks_like_key"
    for i, c in enumerate(["p_name", "p_brand", "p_type", "code"])))
def b01(spark, sf):
    p = table(spark, sf, "part").withColumn("code", F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("N")))
    return V.key_column_scores(p, "p_partkey")


@query("b01_detect_key_column", "SELECT 'code' AS key_column")
def b01b(spark, sf):
    p = table(spark, sf, "part").withColumn("code", F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("N")))
    return V.detect_key_column(p, "p_partkey")


def _rate_sql(col: str) -> str:
    return (f"(SELECT avg(CASE WHEN regexp_matches({col}, '^Customer#[0-9]+$') THEN 1.0 ELSE 0.0 END) FROM "
            f"customer WHERE {col} IS NOT NULL)")


@query("b02_key_columns_by_validity", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {_rate_sql(c)} AS valid_rate, "
    f"({str('seg' in c).lower()} OR {_rate_sql(c)} > 0.8) AS is_key" for c in ["c_name", "c_mktsegment"]))
def b02(spark, sf):
    c = table(spark, sf, "customer")
    return V.key_columns_by_validity(c, "c_custkey", lambda x: x.rlike("^Customer#[0-9]+$"), "seg")


@query("b03_prepare_xy", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice FROM lineitem")
def b03(spark, sf):
    return V.prepare_xy(table(spark, sf, "lineitem"), "l_extendedprice", "l_orderkey",
                        exclude=["l_partkey", "l_suppkey"])


def _types_sql(tbl, cols, rule):
    parts = []
    for c, kind in cols:
        nd = f"(SELECT CAST(count(DISTINCT {c}) AS BIGINT) FROM {tbl})"
        parts.append(f"SELECT '{c}' AS column_name, {nd} AS n_distinct, {rule(nd, kind)} AS column_type")
    return " UNION ALL ".join(parts)


def _b04_rule(nd, kind):
    if kind == "str":
        return f"CASE WHEN {nd} <= 2 THEN 'binary' ELSE 'categorical' END"
    cnt = "WHEN {nd} <= 20 THEN 'integer_count' ".format(nd=nd) if kind == "int" else ""
    return f"CASE WHEN {nd} <= 2 THEN 'binary' {cnt}ELSE 'continuous' END"


_LI_KINDS = [("l_partkey", "int"), ("l_suppkey", "int"), ("l_linenumber", "int"), ("l_quantity", "dbl"),
             ("l_extendedprice", "dbl"), ("l_discount", "dbl"), ("l_tax", "dbl"), ("l_returnflag", "str"),
             ("l_linestatus", "str"), ("l_shipdate", "str")]


@query("b04_column_types", _types_sql("lineitem", _LI_KINDS, _b04_rule))
def b04(spark, sf):
    return V.column_types(table(spark, sf, "lineitem"), skip=["l_orderkey"])


def _b05_rule(nd, kind):
    if kind == "str":
        return "'categorical'"
    return f"CASE WHEN {nd} > 10 THEN 'continuous' WHEN {nd} < 10 THEN 'categorical' END"


@query("b05_column_types_alt", _types_sql("part", [("p_name", "str"), ("p_brand", "str"), ("p_type", "str"),
                                                   ("p_size", "int"), ("p_retailprice", "dbl")], _b05_rule))
def b05(spark, sf):
    return V.column_types_alt(table(spark, sf, "part"), skip=["p_partkey"])


_CUST_NULLS = {"c_name": "c_custkey", "c_nationkey": "c_custkey", "c_acctbal": "c_custkey",
               "c_mktsegment": "c_custkey"}
_CUST_COLS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


@query("b07_validate_table", f"""
WITH c AS (SELECT {inject_nulls_sql(_CUST_COLS, _CUST_NULLS)} FROM customer),
s AS (SELECT count(*) AS n,
      count_if(c_custkey IS NULL) + count_if(c_name IS NULL) + count_if(c_nationkey IS NULL)
      + count_if(c_acctbal IS NULL OR isnan(c_acctbal)) + count_if(c_mktsegment IS NULL) AS m FROM c),
d AS (SELECT coalesce(sum(k - 1), 0) AS dd FROM (SELECT count(*) AS k FROM c GROUP BY c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment))
SELECT 'error' AS level, 'missing_column:c_phone' AS code, CAST(NULL AS DOUBLE) AS value
UNION ALL SELECT 'error', 'not_numeric:c_mktsegment', NULL
UNION ALL SELECT 'warning', 'high_missing_rate', {r('m / (n * 5.0) * 100')} FROM s WHERE m / (n * 5.0) * 100 > 10
UNION ALL SELECT 'warning', 'duplicates', {r('dd / n * 100')} FROM s, d WHERE dd / n * 100 > 5""")
def b07(spark, sf):
    c = inject_nulls(table(spark, sf, "customer"), _CUST_NULLS)
    out = V.validate_table(c, ["c_custkey", "c_phone"], ["c_acctbal", "c_mktsegment"])
    return out.withColumn("value", r6(F.col("value")))


_DOC_CHECKS_SQL = [("empty", "length(trim(text)) > 0"), ("too_short", "n_chars >= 200"),
                   ("unknown_lang", "lang IN ('en', 'fr', 'de')")]


def _doc_checks():
    return [("empty", F.length(F.trim("text")) > 0), ("too_short", F.col("n_chars") >= 200),
            ("unknown_lang", F.col("lang").isin("en", "fr", "de"))]


@query("b08_rejected_rows", "SELECT doc_id, CASE " + " ".join(
    f"WHEN NOT coalesce({c}, false) THEN '{n}'" for n, c in _DOC_CHECKS_SQL)
    + " END AS reject_reason FROM documents WHERE NOT (" + " AND ".join(
        f"coalesce({c}, false)" for _, c in _DOC_CHECKS_SQL) + ")")
def b08(spark, sf):
    _, bad = V.split_valid(table(spark, sf, "documents"), _doc_checks())
    return bad.select("doc_id", "reject_reason")


@query("b08_validity_summary", "SELECT count(*) AS total, count_if(" + " AND ".join(
    f"coalesce({c}, false)" for _, c in _DOC_CHECKS_SQL) + ") AS successful, count(*) - count_if(" + " AND ".join(
    f"coalesce({c}, false)" for _, c in _DOC_CHECKS_SQL) + ") AS failed, " + r(
    "count_if(" + " AND ".join(f"coalesce({c}, false)" for _, c in _DOC_CHECKS_SQL) + ") / count(*)")
    + " AS success_rate FROM documents")
def b08b(spark, sf):
    s = V.validity_summary(table(spark, sf, "documents"), _doc_checks())
    return s.withColumn("success_rate", r6(F.col("success_rate")))


@query("b09_numeric_rule", """
WITH l AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS d FROM lineitem)
SELECT CASE WHEN d IS NULL THEN 'null' WHEN d < 0.02 THEN 'below_min' WHEN d > 0.08 THEN 'above_max'
            ELSE 'ok' END AS status, count(*) AS n FROM l GROUP BY 1""")
def b09(spark, sf):
    li = inject_nulls(table(spark, sf, "lineitem"), {"l_discount": "l_orderkey"})
    return li.select(V.numeric_rule(F.col("l_discount"), 0.02, 0.08).alias("status")).groupBy("status").agg(
        F.count(F.lit(1)).alias("n"))


_ORDER_RULES = [
    {"column": "o_orderpriority", "required": True},
    {"column": "o_totalprice", "type": "double", "min": 1000.0, "max": 400000.0},
    {"column": "o_orderstatus", "choices": ["F", "O"]},
]


@query("b10_rule_violations", """
SELECT v AS violation, count(*) AS n FROM (
  SELECT unnest(list_filter([
    CASE WHEN o_orderpriority IS NULL THEN 'o_orderpriority:required' END,
    CASE WHEN o_totalprice < 1000.0 THEN 'o_totalprice:min' END,
    CASE WHEN o_totalprice > 400000.0 THEN 'o_totalprice:max' END,
    CASE WHEN o_orderstatus IS NOT NULL AND o_orderstatus NOT IN ('F', 'O') THEN 'o_orderstatus:choices' END],
    lambda x: x IS NOT NULL)) AS v FROM orders) GROUP BY v""")
def b10(spark, sf):
    o = table(spark, sf, "orders")
    return (o.select(F.explode(V.rule_violations(_ORDER_RULES)).alias("violation"))
            .groupBy("violation").agg(F.count(F.lit(1)).alias("n")))


def _allowed_class() -> str:
    return "".join("\\" + ch if ch in "[]\\^-" else ch for ch in sorted(set(V.SANITIZE_ALLOWED)))


_DANGER = "(?i)(" + "|".join(V.DANGEROUS_PATTERNS) + ")"


@query("b11_sanitize_and_guard", f"""
SELECT page_id, substr(regexp_replace(url, '[^{_allowed_class()}]', '', 'g'), 1, 500) AS url_sanitized,
  (coalesce(length(url), 0) > 0 AND length(url) <= 1000 AND NOT regexp_matches(url, '{_DANGER}')) AS url_safe,
  (coalesce(length(html), 0) > 0 AND length(html) <= 10000000 AND NOT regexp_matches(html, '{_DANGER}')) AS html_safe
FROM pages""")
def b11(spark, sf):
    p = table(spark, sf, "pages")
    return p.select("page_id", V.sanitize(F.col("url")).alias("url_sanitized"),
                    V.is_safe_input(F.col("url")).alias("url_safe"),
                    V.is_safe_input(F.col("html"), 10_000_000).alias("html_safe"))


_PRESETS = {"default": ["l_quantity", "l_extendedprice"], "pricing": ["l_extendedprice", "l_discount", "l_tax"]}


@query("b12_column_preset", "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount FROM lineitem")
def b12(spark, sf):
    li = table(spark, sf, "lineitem")
    cols = R.preset_columns(li.columns, _PRESETS, "pricing", add=["l_quantity", "no_such"], remove=["l_tax"])
    return li.select("l_orderkey", *cols)


@query("b13_druglike_rule", """
SELECT l_orderkey, l_linenumber,
  CAST((l_extendedprice / 100 > 500)::INT + (l_quantity / 10 > 5)::INT + (l_linenumber > 5)::INT
       + (l_quantity / 4 > 10)::INT AS INT) AS violations,
  ((l_extendedprice / 100 > 500)::INT + (l_quantity / 10 > 5)::INT + (l_linenumber > 5)::INT
       + (l_quantity / 4 > 10)::INT) <= 1 AS passes
FROM lineitem""")
def b13(spark, sf):
    li = table(spark, sf, "lineitem")
    v, ok = R.lipinski(F.col("l_extendedprice") / 100, F.col("l_quantity") / 10, F.col("l_linenumber"),
                       F.col("l_quantity") / 4)
    return li.select("l_orderkey", "l_linenumber", v.alias("violations"), ok.alias("passes"))


@query("b14_linear_score_bands", f"""
WITH x AS (SELECT p_partkey, p_size / 10.0 AS logp, p_retailprice / 5.0 AS mw, p_size % 7 AS rot,
                  length(p_name) % 3 AS arom FROM part),
y AS (SELECT *, 0.16 - 0.63 * logp - 0.0062 * mw + 0.066 * rot - 0.74 * arom AS logs FROM x)
SELECT p_partkey, {r('logs')} AS log_s, {r('pow(10.0, logs) * mw / 1000')} AS mg_ml,
  CASE WHEN logs > 0 THEN 'high' WHEN logs > -2 THEN 'medium' WHEN logs > -4 THEN 'low' ELSE 'insoluble' END AS solubility_class
FROM y""")
def b14(spark, sf):
    p = table(spark, sf, "part")
    logs, mg, cls = R.esol(F.col("p_size") / 10.0, F.col("p_retailprice") / 5.0, F.col("p_size") % 7,
                           F.length("p_name") % 3)
    return p.select("p_partkey", r6(logs).alias("log_s"), r6(mg).alias("mg_ml"), cls.alias("solubility_class"))


def _admet_frame(li):
    return li.select("l_orderkey", "l_linenumber",
                     (F.col("l_extendedprice") / 100).alias("mw"), (F.col("l_quantity") / 10 - 1).alias("logp"),
                     (F.col("l_tax") * 1000).alias("tpsa"), F.col("l_linenumber").alias("hbd"),
                     (F.col("l_returnflag") == "R").alias("basic_n"),
                     (F.col("l_quantity").cast("int") % 4).alias("n_alerts"))


@query("b15_admet_scores", f"""
WITH x AS (SELECT l_orderkey, l_linenumber, l_extendedprice / 100 AS mw, l_quantity / 10 - 1 AS logp,
                  l_tax * 1000 AS tpsa, l_linenumber AS hbd, l_returnflag = 'R' AS basic_n,
                  CAST(l_quantity AS INT) % 4 AS n_alerts FROM lineitem),
y AS (SELECT *, round(CASE WHEN mw > 500 THEN least(100.0, greatest(0.0, 100.0 - tpsa / 2)) * 0.8
                   ELSE least(100.0, greatest(0.0, 100.0 - tpsa / 2)) END, 1) AS hia,
             round(0.3 * logp - 0.02 * tpsa - 0.2 * hbd, 2) AS bbb,
             logp > 3.5 AND basic_n AS herg FROM x),
z AS (SELECT *, CASE WHEN hia <> 0 THEN hia / 100 END AS absorption,
             CASE WHEN bbb <> 0 THEN least(1.0, greatest(0.0, (bbb + 1) / 2)) END AS cns,
             greatest(0.0, 1.0 - 0.2 * n_alerts - CASE WHEN herg THEN 0.3 ELSE 0.0 END) AS safety FROM y)
SELECT l_orderkey, l_linenumber, hia, round(-5.0 - tpsa / 100 - mw / 1000, 2) AS caco2,
  CAST(greatest(0, least(100, 100 - CASE WHEN mw > 500 THEN 20 ELSE 0 END
       - CASE WHEN logp > 5 OR logp < 0 THEN 15 ELSE 0 END - CASE WHEN hbd > 5 THEN 20 ELSE 0 END)) AS DOUBLE) AS bioavailability,
  bbb, round(least(99.0, greatest(10.0, 50 + 10 * logp)), 1) AS ppb, round(0.5 + 0.3 * logp, 2) AS vdss,
  herg AS herg_inhibition, n_alerts > 2 AS ames_mutagenicity, {r('safety')} AS safety,
  {r('(coalesce(absorption, 0) + coalesce(cns, 0) + safety) / (1 + (absorption IS NOT NULL)::INT + (cns IS NOT NULL)::INT)')} AS overall
FROM z""")
def b15(spark, sf):
    x = _admet_frame(table(spark, sf, "lineitem"))
    a = R.admet(F.col("mw"), F.col("logp"), F.col("tpsa"), F.col("hbd"), F.col("basic_n"), F.col("n_alerts"))
    return x.select("l_orderkey", "l_linenumber", a["hia"].alias("hia"), a["caco2"].alias("caco2"),
                    a["bioavailability"].alias("bioavailability"), a["bbb"].alias("bbb"), a["ppb"].alias("ppb"),
                    a["vdss"].alias("vdss"), a["herg_inhibition"].alias("herg_inhibition"),
                    a["ames_mutagenicity"].alias("ames_mutagenicity"), r6(a["safety"]).alias("safety"),
                    r6(a["overall"]).alias("overall"))


# fixed values: text alert rules (pattern, name, category, severity)
TEXT_ALERTS = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "email", "privacy", "medium"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "ip_address", "privacy", "low"),
    (r"555-[0-9]{4}", "phone", "privacy", "medium"),
    (r"[A-Za-z0-9]{32,}", "secret_token", "secret", "high"),
    (r"(?i)licen[cs]e", "license", "license", "low"),
    (r"[*#%]{3,}", "junk_run", "junk", "low"),
]
ALERT_CATEGORIES = ["privacy", "secret", "license", "junk"]


def _b16_sql():
    cnt = [f"len(regexp_extract_all(text, '{p}'))" for p, _, _, _ in TEXT_ALERTS]
    w = " + ".join(f"{c} * {R.SEVERITY_WEIGHT[s]}" for c, (_, _, _, s) in zip(cnt, TEXT_ALERTS))
    cats = ", ".join("(" + " OR ".join(f"{c} > 0" for c, (_, _, rc, _) in zip(cnt, TEXT_ALERTS) if rc == cat)
                     + f") AS {cat}" for cat in ALERT_CATEGORIES)
    return (f"SELECT doc_id, CAST({' + '.join(cnt)} AS BIGINT) AS n_alerts, {r(f'least(1.0, ({w}) / 10.0)')} AS risk_score, "
            f"least(1.0, ({w}) / 10.0) > 0.3 AS is_flagged, {cats} FROM documents")


@query("b16_alert_profile", _b16_sql())
def b16(spark, sf):
    d = table(spark, sf, "documents")
    a = R.alert_profile(F.col("text"), TEXT_ALERTS, ALERT_CATEGORIES)
    return d.select("doc_id", a["n_alerts"].alias("n_alerts"), r6(a["risk_score"]).alias("risk_score"),
                    a["is_flagged"].alias("is_flagged"), *[a[c].alias(c) for c in ALERT_CATEGORIES])


@query("b17_complexity_rank", f"""
WITH x AS (SELECT p_partkey, p_size * 0.1::DOUBLE + (len(string_split(p_name, ' ')) - 1) * 0.5::DOUBLE
                  + (p_size % 3) * 1.0::DOUBLE + length(p_type) * 0.1::DOUBLE AS cx,
                  len(regexp_extract_all(p_name, 'ring')) AS al FROM part),
y AS (SELECT *, least(10.0::DOUBLE, 1.0::DOUBLE + least(9.0::DOUBLE, cx) + 0.5::DOUBLE * al) AS sa FROM x)
SELECT p_partkey, {r('cx')} AS complexity, {r('sa')} AS sa_score,
  CASE WHEN sa <= 3 THEN 'easy' WHEN sa <= 5 THEN 'moderate' WHEN sa <= 7 THEN 'hard' ELSE 'very_hard' END AS difficulty,
  sa < 6 AS is_synthesizable FROM y ORDER BY sa, p_partkey""")
def b17(spark, sf):
    p = table(spark, sf, "part")
    c = R.complexity_score(F.col("p_size"), F.size(F.split("p_name", " ")) - 1, F.col("p_size") % 3,
                           F.length("p_type"), F.regexp_count("p_name", F.lit("ring")))
    return p.select("p_partkey", r6(c["complexity"]).alias("complexity"), r6(c["sa_score"]).alias("sa_score"),
                    c["difficulty"].alias("difficulty"), c["is_synthesizable"].alias("is_synthesizable")) \
        .orderBy("sa_score", "p_partkey")


def _pk_frame(spark, sf):
    p = table(spark, sf, "part")
    return p.select("p_partkey", (F.col("p_retailprice") / 1000).alias("logp"),
                    F.array_compact(F.array(F.when(F.col("p_size") % 2 == 0, F.col("p_size") / 4.0))).alias("pka"),
                    F.array(F.col("p_size") / 5.0 + 2.0).alias("pkb"))


@query("b18_logd_curve", f"""
WITH g AS (SELECT p_partkey, p_retailprice / 1000 AS logp, p_size, i, i * (14.0::DOUBLE / 49.0::DOUBLE) AS ph
           FROM part, range(0, 50) t(i))
SELECT p_partkey, CAST(i AS INT) AS i, {r('ph')} AS ph,
  {r('logp - 0.5 * CASE WHEN p_size % 2 = 0 THEN 1 / (1 + pow(10.0, p_size / 4.0 - ph)) ELSE 0.0 END - 0.5 * (1 / (1 + pow(10.0, ph - (p_size / 5.0 + 2.0))))')} AS logd
FROM g""")
def b18(spark, sf):
    out = R.logd_curve(_pk_frame(spark, sf), "p_partkey", "logp", "pka", "pkb")
    return out.withColumn("ph", r6(F.col("ph"))).withColumn("logd", r6(F.col("logd")))


@query("b18_dominant_species", """
SELECT p_partkey, CASE
  WHEN (CASE WHEN 7.4 < p_size / 5.0 + 2.0 - 1 THEN 1 ELSE 0 END) - (CASE WHEN p_size % 2 = 0 AND 7.4 > p_size / 4.0 + 1 THEN 1 ELSE 0 END) > 0 THEN 'Cationic'
  WHEN (CASE WHEN 7.4 < p_size / 5.0 + 2.0 - 1 THEN 1 ELSE 0 END) - (CASE WHEN p_size % 2 = 0 AND 7.4 > p_size / 4.0 + 1 THEN 1 ELSE 0 END) < 0 THEN 'Anionic'
  ELSE 'Zwitterionic' END AS species FROM part""")
def b18b(spark, sf):
    x = _pk_frame(spark, sf)
    return x.select("p_partkey", R.dominant_species(F.col("pka"), F.col("pkb"), 7.4).alias("species"))


_MASS_VALUES = ", ".join(f"('{k}', {v})" for k, v in R.RESIDUE_MASS.items())


@query("b19_sequence_mass", f"""
WITH m(res, w) AS (VALUES {_MASS_VALUES}),
ch AS (SELECT c_custkey, unnest(string_split(upper(c_name), '')) AS res FROM customer)
SELECT c.c_custkey, CAST(length(c.c_name) AS INT) AS seq_len,
  {r('coalesce(s.tw, 0.0) - 18 * (length(c.c_name) - 1)')} AS mass
FROM customer c LEFT JOIN (SELECT c_custkey, sum(coalesce(m.w, 0.0)) AS tw FROM ch LEFT JOIN m USING (res)
  GROUP BY c_custkey) s USING (c_custkey)""")
def b19(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.length("c_name").alias("seq_len"), r6(R.sequence_mass(F.col("c_name"))).alias("mass"))


@query("b19_sequence_composition", f"""
SELECT c_custkey, res AS residue, {r('count(*) / max(length(c_name))')} AS fraction
FROM (SELECT c_custkey, c_name, unnest(string_split(upper(c_name), '')) AS res FROM customer)
GROUP BY c_custkey, res""")
def b19b(spark, sf):
    out = R.sequence_composition(table(spark, sf, "customer"), "c_custkey", "c_name")
    return out.withColumn("fraction", r6(F.col("fraction")))


@query("b19_motif_positions", """
SELECT c_custkey, CAST(list_filter(range(0, length(c_name) - 1), lambda i: substr(upper(c_name), i + 1, 2) = '00')
  AS INT[]) AS positions FROM customer""")
def b19c(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", R.motif_positions(F.col("c_name"), "00").alias("positions"))


_MIX_STR_SQL = """CASE l_linenumber % 3
  WHEN 0 THEN CAST(l_partkey AS VARCHAR) || ':' || CAST(l_quantity AS VARCHAR) || ', ' || CAST(l_suppkey AS VARCHAR) || ':' || CAST(100 - l_quantity AS VARCHAR)
  WHEN 1 THEN CAST(l_partkey AS VARCHAR) || '|' || CAST(l_quantity / 100 AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR) || '|' || CAST(1 - l_quantity / 100 AS VARCHAR)
  ELSE 'P' || CAST(l_partkey AS VARCHAR) END"""


def _mix_str():
    p, q, s = F.col("l_partkey").cast("string"), F.col("l_quantity"), F.col("l_suppkey").cast("string")
    return (F.when(F.col("l_linenumber") % 3 == 0,
                   F.concat(p, F.lit(":"), q.cast("string"), F.lit(", "), s, F.lit(":"), (100 - q).cast("string")))
            .when(F.col("l_linenumber") % 3 == 1,
                  F.concat(p, F.lit("|"), (q / 100).cast("string"), F.lit("|"), s, F.lit("|"), (1 - q / 100).cast("string")))
            .otherwise(F.concat(F.lit("P"), p)))


@query("b20_parse_mixture", f"""
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_linenumber % 3 AS f FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR) AS key,
  {r('CASE WHEN f = 0 THEN CASE WHEN l_quantity > 1 THEN l_quantity / 100 ELSE l_quantity END ELSE l_quantity / 100 END')} AS ratio FROM s WHERE f IN (0, 1)
UNION ALL SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR),
  {r('CASE WHEN f = 0 THEN CASE WHEN 100 - l_quantity > 1 THEN (100 - l_quantity) / 100 ELSE 100 - l_quantity END ELSE 1 - l_quantity / 100 END')} FROM s WHERE f IN (0, 1)
UNION ALL SELECT l_orderkey, l_linenumber, 'P' || CAST(l_partkey AS VARCHAR), 1.0 FROM s WHERE f = 2""")
def b20(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.parse_mixture(_mix_str()).alias("m"))
    return li.select("l_orderkey", "l_linenumber", F.inline("m")).withColumn("ratio", r6(F.col("ratio")))


@query("b21_hashed_bits", """
WITH t AS (SELECT doc_id, list_sort(list_distinct(list_transform(
    list_filter(string_split_regex(lower(text), '[ \t\r\n]+'), lambda w: length(w) > 0),
    lambda w: CAST((('0x' || substr(md5(w), 1, 8))::UBIGINT % 1024) AS BIGINT)))) AS on_bits FROM documents)
SELECT doc_id, on_bits, CAST(len(on_bits) AS INT) AS bit_count, round(len(on_bits) / 1024.0, 6) AS density FROM t""")
def b21(spark, sf):
    d = table(spark, sf, "documents")
    bits = R.hashed_bits(R.tokens(F.col("text")), 1024)
    return d.select("doc_id", bits.alias("on_bits")).select(
        "doc_id", "on_bits", F.size("on_bits").alias("bit_count"), r6(F.size("on_bits") / 1024.0).alias("density"))


@query("b22_fusion", """
SELECT vec_id,
  list_transform(range(0, 32), lambda i: round((CAST(embedding[i + 1] AS DOUBLE) + CAST(embedding[i + 33] AS DOUBLE)) / 2, 6)) AS fused_avg,
  list_transform(range(0, 32), lambda i: round(greatest(CAST(embedding[i + 1] AS DOUBLE), CAST(embedding[i + 33] AS DOUBLE)), 6)) AS fused_max,
  CAST(len(embedding) AS INT) AS concat_len
FROM embeddings""")
def b22(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    a, b = F.slice("e", 1, 32), F.slice("e", 33, 32)
    return e.select("vec_id", F.transform(R.fuse(a, b, "average"), lambda x: F.round(x, 6)).alias("fused_avg"),
                    F.transform(R.fuse(a, b, "max"), lambda x: F.round(x, 6)).alias("fused_max"),
                    F.size(R.fuse(a, b, "concat")).alias("concat_len"))


@query("b23_feature_union", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, p_size, p_retailprice
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def b23(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice")
    return li.join(p, li.l_partkey == p.p_partkey).drop("l_partkey", "p_partkey")


_B24_W = {"l_quantity": 0.5, "l_extendedprice": 0.001, "l_discount": -20.0, "l_tax": 10.0}


@query("b24_top_attributions", """
WITH m AS (SELECT avg(l_quantity) AS l_quantity_m, avg(l_extendedprice) AS l_extendedprice_m,
                  avg(l_discount) AS l_discount_m, avg(l_tax) AS l_tax_m FROM lineitem),
c AS (SELECT l_orderkey, l_linenumber, [""" + ", ".join(
    f"{{'v': round({w} * ({f} - {f}_m), 6), 'f': '{f}'}}" for f, w in _B24_W.items()) + """] AS arr FROM lineitem, m)
SELECT l_orderkey, l_linenumber,
  list_transform(list_slice(list_sort(list_transform(list_filter(arr, lambda x: x.v > 0), lambda x: {'k': -x.v, 'f': x.f})), 1, 5), lambda x: x.f) AS top_positive,
  list_transform(list_slice(list_sort(list_transform(list_filter(arr, lambda x: x.v < 0), lambda x: {'k': x.v, 'f': x.f})), 1, 5), lambda x: x.f) AS top_negative
FROM c""")
def b24(spark, sf):
    li = table(spark, sf, "lineitem")
    means = li.agg(*[F.avg(f).alias(f) for f in _B24_W])
    x = bind_stats(li, means, "_m")
    contribs = [F.round(F.lit(w) * (F.col(f) - F.col(f"_m.{f}")), 6) for f, w in _B24_W.items()]
    pos, neg = R.top_contributions(list(_B24_W), contribs, 5)
    return x.select("l_orderkey", "l_linenumber", pos.alias("top_positive"), neg.alias("top_negative"))
