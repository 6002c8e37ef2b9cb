"""Queries of the numbered operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle
from .common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), vocabulary())


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents"))


@query("op6_decontamination")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import decontaminate

    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("items")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"), vocabulary())


@query("op10_jaccard_join")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(read(spark, sf_dir, "documents"))


@query("op8_quality_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(read(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op7_license_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(read(spark, sf_dir, "documents"))


@query("op2_html_text")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(read(spark, sf_dir, "pages"))


@query("op4_warc")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import round_trip

    return round_trip(read(spark, sf_dir, "pages"))


@query("op11_periodic_runs", oracle.PERIODIC_RUNS)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import digests, periodic_runs, planted

    return digests(periodic_runs(read(spark, sf_dir, "documents"), rewrite=planted))


@query("op12_lexical_search", oracle.LEXICAL_SEARCH)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexical_search import lexical_search

    return lexical_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op13_pii")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import digests, personal_data

    return digests(personal_data(read(spark, sf_dir, "documents")))
