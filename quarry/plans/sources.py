"""Registered source / sink / store queries (A01–A23).  Round trips write
to a fresh folder under the session's checkpoint dir and read it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..session import scratch_path
from ..sources import io as IO
from ..sources import store as S
from ..sources.tables import table
from .registry import query

PART_TYPES = {"p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string",
              "p_size": "int", "p_retailprice": "double"}


@query("a01_read_csv", "SELECT * FROM part")
def a01(spark, sf):
    p = table(spark, sf, "part")
    path = scratch_path(spark, "csv")
    # upper-case, padded header names exercise the name normalisation
    p.toDF(*[f" {c.upper()} " for c in p.columns]).write.option("header", True).csv(path)
    return IO.read_csv(spark, path, key_column="p_name", types=PART_TYPES)


@query("a02_read_tsv", "SELECT * FROM nation")
def a02(spark, sf):
    n = table(spark, sf, "nation")
    path = scratch_path(spark, "tsv")
    IO.export_data(n, path, "tsv")
    return IO.read_tsv(spark, path, "n_name", {"n_nationkey": "int", "n_regionkey": "int"})


@query("a03_read_json", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def a03(spark, sf):
    o = table(spark, sf, "orders").drop("o_orderdate")
    path = scratch_path(spark, "json")
    IO.export_data(o, path, "jsonl")
    return IO.read_json(spark, path, "o_orderkey", multiline=False,
                        schema=o.schema).select(*o.columns)


@query("a04_read_jsonl_good", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k "
       "FROM events WHERE event_id % 13 <> 0")
def a04(spark, sf):
    good, _ = _jsonl(spark, sf)
    return good


@query("a04_read_jsonl_bad", "SELECT CAST(count(*) AS BIGINT) AS bad_lines FROM events WHERE event_id % 13 = 0")
def a04b(spark, sf):
    _, bad = _jsonl(spark, sf)
    return bad.agg(F.count(F.lit(1)).alias("bad_lines"))


@query("a04_bad_line_numbers", "SELECT row_number() OVER (ORDER BY event_id) AS line_number, '{bad ' || event_id AS line FROM events "
       "QUALIFY event_id % 13 = 0")
def a04n(spark, sf):
    # One file in the order of event_id, written by one task; the read may split it.
    _, bad = _jsonl(spark, sf, lambda e: e.coalesce(1).sortWithinPartitions("event_id"))
    return bad.select("line_number", "line")


def _jsonl(spark, sf, order=lambda e: e):
    e = order(table(spark, sf, "events"))
    # every 13th line is corrupted on purpose
    line = F.when(F.col("event_id") % 13 == 0, F.concat(F.lit("{bad "), F.col("event_id").cast("string"))) \
        .otherwise(F.concat(F.lit('{"event_id": '), F.col("event_id").cast("string"), F.lit(", "),
                            F.expr("substring(props, 2)")))
    path = scratch_path(spark, "jsonl")
    e.select(line.alias("value")).write.text(path)
    return IO.read_jsonl(spark, path, "event_id bigint, k double", "event_id")


@query("a05_read_records", "SELECT p_name AS title, CAST(p_partkey AS VARCHAR) AS p_partkey, p_brand, "
       "CAST(p_size AS VARCHAR) AS p_size, true AS is_valid FROM part")
def a05(spark, sf):
    p = table(spark, sf, "part")
    path = scratch_path(spark, "records")
    IO.write_records(p, path, "p_name", ["p_partkey", "p_brand", "p_size", "p_type"])
    rec = IO.read_records(spark, path, ["P_PARTKEY", "P_BRAND", "P_SIZE"])
    return rec.select("title", F.col("properties")["P_PARTKEY"].alias("p_partkey"),
                      F.col("properties")["P_BRAND"].alias("p_brand"),
                      F.col("properties")["P_SIZE"].alias("p_size"), "is_valid")


@query("a07_export_csv_roundtrip", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, "
       "l_returnflag FROM lineitem")
def a07(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                             "l_extendedprice", "l_returnflag")
    path = scratch_path(spark, "export") + ".csv"
    IO.export_data(li, path)
    return IO.import_data(spark, path).select(
        F.col("l_orderkey").cast("bigint").alias("l_orderkey"),
        F.col("l_linenumber").cast("int").alias("l_linenumber"),
        F.col("l_quantity").cast("double").alias("l_quantity"),
        F.col("l_extendedprice").cast("double").alias("l_extendedprice"), "l_returnflag")


_UPSERT_SQL = """
WITH u AS (
  SELECT p_name, p_brand, p_type, p_size, p_retailprice, p_partkey AS seq FROM part
  UNION ALL
  SELECT p_name, p_brand, p_type, p_size, p_retailprice * 1.1 AS p_retailprice,
         1000000000000 + p_partkey AS seq FROM part WHERE p_size > 25),
r AS (SELECT *, substr(md5(p_name), 1, 16) AS id,
      row_number() OVER (PARTITION BY substr(md5(p_name), 1, 16) ORDER BY seq DESC) AS rn FROM u)
SELECT id, p_name, p_brand, p_type, p_size, round(p_retailprice, 4) AS p_retailprice, seq FROM r WHERE rn = 1"""


@query("a09_entity_upsert", _UPSERT_SQL)
def a09(spark, sf):
    p = table(spark, sf, "part").select("p_name", "p_brand", "p_type", "p_size", "p_retailprice",
                                        F.col("p_partkey").alias("seq"))
    upd = p.where("p_size > 25").withColumn("p_retailprice", F.col("p_retailprice") * 1.1) \
        .withColumn("seq", F.lit(1000000000000) + F.col("seq"))
    out = S.upsert(p, upd, "p_name", "seq")
    return out.withColumn("p_retailprice", F.round("p_retailprice", 4))


@query("a10_point_lookup", "SELECT * FROM part WHERE p_name = 'red widget'")
def a10(spark, sf):
    return S.lookup(table(spark, sf, "part"), "p_name", "red widget")


@query("a11_entity_search", """
SELECT * FROM part WHERE p_type = 'ECONOMY' AND p_name ILIKE '%ring%'
  AND p_retailprice BETWEEN 900 AND 1500
ORDER BY p_partkey LIMIT 20""")
def a11(spark, sf):
    p = table(spark, sf, "part").withColumn("__tags", F.array("p_type", "p_brand"))
    return S.search(p, "p_partkey", "__tags", ["ECONOMY"], "p_retailprice", (900, 1500),
                    "p_name", "RING", 20).drop("__tags")


@query("a12_newest_first", "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders")
def a12(spark, sf):
    return S.newest_first(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"),
                          "o_orderdate", "o_orderkey")


@query("a13_partial_update", """
SELECT o.o_orderkey, coalesce(p.st, o.o_orderstatus) AS o_orderstatus, o.o_totalprice,
       CASE WHEN p.o_orderkey IS NOT NULL THEN 'patched' END AS updated_at
FROM orders o LEFT JOIN (SELECT o_orderkey, 'X' AS st FROM orders WHERE o_orderpriority = '1-URGENT') p
ON o.o_orderkey = p.o_orderkey""")
def a13(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    patch = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", F.lit("X").alias("o_orderstatus"))
    return S.partial_update(o, patch, "o_orderkey", ["o_orderstatus"], "updated_at", "patched")


@query("a14_get_or_create_parents", """
WITH p AS (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0),
refs AS (SELECT DISTINCT l_suppkey AS s_suppkey FROM lineitem)
SELECT s_suppkey, false AS is_new FROM p
UNION ALL SELECT s_suppkey, true AS is_new FROM refs WHERE s_suppkey NOT IN (SELECT s_suppkey FROM p)""")
def a14(spark, sf):
    parents = table(spark, sf, "supplier").where("s_acctbal > 0")
    allp, _ = S.append_measurements(parents, "s_suppkey", table(spark, sf, "lineitem"), "l_suppkey",
                                    "l_extendedprice", "run1", "price")
    return allp


@query("a14_append_measurements", """
SELECT l_suppkey AS entity_id, 'run1' AS run_id, 'price' AS property, l_extendedprice AS value,
       l_tax AS uncertainty FROM lineitem""")
def a14b(spark, sf):
    _, long = S.append_measurements(table(spark, sf, "supplier"), "s_suppkey", table(spark, sf, "lineitem"),
                                    "l_suppkey", "l_extendedprice", "run1", "price", "l_tax")
    return long


@query("a15_flatten_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, "
       "event_type || ',' || CAST(user_id AS VARCHAR) AS tags FROM events")
def a15(spark, sf):
    e = table(spark, sf, "events")
    e = e.select("event_id", F.from_json("props", S.PROPS_SCHEMA).alias("m"),
                 F.concat_ws(",", F.array("event_type", F.col("user_id").cast("string"))).alias("tags"))
    return S.flatten_map(e, "m", ["k"])


def _customer_features(spark, sf):
    o = table(spark, sf, "orders")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total_spend"),
        F.round(F.avg("o_totalprice"), 6).alias("avg_order"))


@query("a16_feature_register", """
SELECT o_custkey AS id, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_spend,
       round(avg(o_totalprice), 6) AS avg_order FROM orders GROUP BY o_custkey""")
def a16(spark, sf):
    fs = S.FeatureStore(spark)
    fs.register("customer_orders", _customer_features(spark, sf), "id")
    return fs.get("customer_orders")


@query("a17_feature_get", """
SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS total_spend FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
GROUP BY o_custkey""")
def a17(spark, sf):
    fs = S.FeatureStore(spark)
    fs.register("customer_orders", _customer_features(spark, sf), "id")
    ids = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select("c_custkey")
    return fs.get("customer_orders", ["total_spend", "no_such_feature"], ids)


@query("a18_feature_search", "SELECT 'customer_orders' AS \"group\", 'avg_order' AS name, 'double' AS dtype, "
       "'mean order value' AS description, count(DISTINCT o_custkey) AS n_rows, "
       "count(DISTINCT CASE WHEN o_totalprice IS NOT NULL THEN o_custkey END) AS n_values FROM orders")
def a18(spark, sf):
    fs = S.FeatureStore(spark)
    fs.register("customer_orders", _customer_features(spark, sf), "id", {"avg_order": "mean order value"})
    return fs.search("AVG")


@query("a19_version_commit", "SELECT 1 AS version, CAST(count(*) AS BIGINT) AS n_rows, 3 AS n_cols FROM nation "
       "UNION ALL SELECT 2, CAST(count(*) AS BIGINT), 3 FROM nation WHERE n_regionkey <> 0")
def a19(spark, sf):
    dv = S.DataVersions(spark)
    n = table(spark, sf, "nation")
    dv.commit("nation", n, "initial")
    dv.commit("nation", n.orderBy(F.desc("n_nationkey")), "same content, other order")
    dv.commit("nation", n.where("n_regionkey <> 0"), "drop region 0")
    return dv.list_versions("nation").select("version", "n_rows", "n_cols")


@query("a20_version_checkout", "SELECT * FROM nation WHERE n_regionkey <> 0")
def a20(spark, sf):
    dv = S.DataVersions(spark)
    n = table(spark, sf, "nation")
    dv.commit("nation", n)
    dv.commit("nation", n.where("n_regionkey <> 0"))
    return dv.checkout("nation")


@query("a21_version_diff", """
WITH a AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderdate < TIMESTAMP '1997-01-01'),
b AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01')
SELECT (SELECT count(*) FROM a) AS rows_v1, (SELECT count(*) FROM b) AS rows_v2,
       (SELECT count(*) FROM b) - (SELECT count(*) FROM a) AS row_delta,
       (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS added_rows,
       (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS removed_rows,
       '' AS columns_added, '' AS columns_removed""")
def a21(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    a = o.where("o_orderdate < TIMESTAMP '1997-01-01'").drop("o_orderdate")
    b = o.where("o_orderdate >= TIMESTAMP '1996-01-01'").drop("o_orderdate")
    return S.table_diff(a, b)


_JOB_STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'failed' ELSE 'running' END"


def _jobs(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderpriority").alias("experiment"),
        F.expr(_JOB_STATUS).alias("status"), F.col("o_orderdate").alias("created_at"))


@query("a22_job_statistics", f"""
SELECT o_orderpriority AS experiment, count(*) AS total_jobs,
       count_if({_JOB_STATUS} = 'completed') AS completed, count_if({_JOB_STATUS} = 'failed') AS failed
FROM orders GROUP BY o_orderpriority""")
def a22(spark, sf):
    return S.job_statistics(_jobs(spark, sf), "status", ["experiment"])


@query("a22_job_list", f"""
SELECT o_orderkey AS job_id, o_orderpriority AS experiment, {_JOB_STATUS} AS status, o_orderdate AS created_at
FROM orders WHERE o_orderpriority = '2-HIGH' AND {_JOB_STATUS} = 'failed'""")
def a22b(spark, sf):
    return S.job_list(_jobs(spark, sf), "created_at", "job_id", "experiment", "2-HIGH", "status", "failed")


@query("a23_audit_log", """
SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'click'
ORDER BY ts DESC, event_id DESC LIMIT 100""")
def a23(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type")
    return S.audit_query(e, "ts", "user_id", "event_type", None, "click", 100, "event_id")


def _a08_frame(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", "c_name", F.col("c_acctbal").cast("decimal(15,2)").alias("c_acctbal"),
                    F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")


@query("a08_export_records", """
SELECT concat_ws(chr(10), c_name,
  '>  <c_acctbal>' || chr(10) || CAST(CAST(c_acctbal AS DECIMAL(15, 2)) AS VARCHAR) || chr(10),
  CASE WHEN c_custkey % 5 <> 0 THEN '>  <c_mktsegment>' || chr(10) || c_mktsegment || chr(10) END,
  '>  <c_nationkey>' || chr(10) || CAST(c_nationkey AS VARCHAR) || chr(10), '$$$$') AS record FROM customer""")
def a08(spark, sf):
    from ..session import scratch_path
    from ..sources import io as IO
    path = scratch_path(spark, "a08")
    IO.export_blocks(_a08_frame(spark, sf), path, "c_name", ["c_acctbal", "c_mktsegment", "c_nationkey"])
    return IO.read_blocks(spark, path)
