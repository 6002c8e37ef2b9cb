"""Shared inputs for the registered queries.  Missing values are injected
deterministically (``key % 7 = 0``) identically in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

LINEITEM_NULLS = {"l_discount": "l_orderkey", "l_tax": "l_partkey"}


def inject_nulls(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    return df.withColumns({c: F.when(F.col(k) % 7 != 0, F.col(c)) for c, k in spec.items()})


def inject_nulls_sql(cols: list[str], spec: dict[str, str]) -> str:
    out = []
    for c in cols:
        if c in spec:
            out.append(f"CASE WHEN {spec[c]} % 7 = 0 THEN NULL ELSE {c} END AS {c}")
        else:
            out.append(c)
    return ", ".join(out)


LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"]
LINEITEM_NUM = LINEITEM_COLS[:8]
LINEITEM_TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint",
                  "l_linenumber": "int", "l_quantity": "double", "l_extendedprice": "double",
                  "l_discount": "double", "l_tax": "double", "l_returnflag": "string",
                  "l_linestatus": "string", "l_shipdate": "timestamp_ntz"}

LI_NULL_CTE = ("li AS (SELECT " + inject_nulls_sql(LINEITEM_COLS, LINEITEM_NULLS)
               + " FROM lineitem)")


def lineitem_nulls(spark: SparkSession, sf: str) -> DataFrame:
    return inject_nulls(table(spark, sf, "lineitem"), LINEITEM_NULLS)


def r(col: str, digits: int = 6) -> str:
    """SQL twin of ``quarry.functions.columns.r6``."""
    return f"(round({col}, {digits}) + 0.0)"


def hsql(seed, key_sql: str) -> str:
    """DuckDB twin of ``hash_u32``."""
    return f"(('0x' || substr(md5('{seed}:' || CAST({key_sql} AS VARCHAR)), 1, 8))::UBIGINT)"


def hunit_sql(seed, key_sql: str) -> str:
    return f"({hsql(seed, key_sql)} / 4294967296.0)"


def sig(col: str, digits: int = 9) -> str:
    """SQL twin of ``quarry.functions.columns.round_sig``."""
    sc = f"pow(10.0, floor(log10(abs({col}))) - {digits - 1})"
    return f"(CASE WHEN {col} = 0 THEN 0.0 ELSE round({col} / {sc}, 0) * {sc} END + 0.0)"
