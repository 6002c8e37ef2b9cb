"""Registered UDF-surface query (U01): a per-item Python function over
``customer.c_acctbal`` with per-item error isolation."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.columns import r6
from ..operators import surface as U
from ..sources.tables import table
from .registry import query


@query("u01_map_items", """
SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN round(sqrt(c_acctbal), 6) + 0.0 END AS value,
  CASE WHEN c_acctbal < 0 THEN 'ValueError: math domain error' END AS error FROM customer""")
def u01(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    out = U.map_items(c, "c_acctbal", math.sqrt)
    return out.select("c_custkey", r6(F.col("value")).alias("value"), "error")


@query("u01_batch_summary", """
SELECT count(*) AS total, sum(CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END)::BIGINT AS successful,
  sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END)::BIGINT AS failed,
  sum(CASE WHEN c_acctbal >= 0 THEN 1 ELSE 0 END) / count(*) AS success_rate FROM customer""")
def u01s(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return U.batch_summary(U.map_items(c, "c_acctbal", math.sqrt))
