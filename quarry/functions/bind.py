"""Attach a one-row statistics frame to every row without a join.

The stats frame becomes one scalar subquery (computed once, inlined as a
literal inside whole-stage codegen) held in a struct column; callers read
fields with ``F.col('<name>.<field>')``.  This is how every fit → transform
pair in this package ships fitted parameters to the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bind_stats(df: DataFrame, stats: DataFrame, name: str = "_st") -> DataFrame:
    sc = stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias(name)).scalar()
    return df.withColumn(name, sc)
