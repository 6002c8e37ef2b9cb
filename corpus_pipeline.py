"""Corpus pipeline: quality rules, n-gram Jaccard join, suffix-array dedup,
benchmark decontamination, packing.

Each stage's result is written as Parquet and read again as the next one's
documents.  All but the last return the columns of ``documents``; columns that
the stages do not know are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import materialize, read
from quarry.llm.decontaminate import clean
from quarry.llm.jaccard_join import one_of_each
from quarry.llm.packing import pack
from quarry.llm.quality_rules import keep_good
from quarry.llm.queries import vocabulary
from quarry.llm.suffix_dedup import without_repeats

#: SQL cannot express the stages; they are tested against brute force.
ORACLE_SQL = None
#: Bytes of a passage that is cut wherever it repeats: under 50 words.
PASSAGE = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles, similarity 0.8."""
    return one_of_each(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of PASSAGE bytes that start anywhere else too."""
    out = without_repeats(docs, length=PASSAGE)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.length("text").cast(kind))
    return out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return clean(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return pack(docs, vocabulary())


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", repeated_passages),
          ("benchmark decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
