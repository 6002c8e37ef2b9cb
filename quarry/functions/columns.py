"""Column-level helpers shared by all operators (all JVM-side expressions)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
           T.DoubleType, T.DecimalType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC) and f.name not in ex]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in ex]


def is_missing(c: str | Column, dtype: T.DataType | None = None) -> Column:
    """pandas-style missing: null, or NaN for floating columns."""
    col = F.col(c) if isinstance(c, str) else c
    if dtype is not None and isinstance(dtype, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def nan_to_null(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(col), col)


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def hash_u32(seed: int | str, key: str | Column) -> Column:
    """Portable seeded bucket: first 8 hex digits of md5('<seed>:<key>') as an
    unsigned 32-bit integer.  Same value on any partitioning and in DuckDB as
    ``('0x'||substr(md5(seed||':'||key),1,8))::UBIGINT``."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), k.cast("string"))), 1, 8),
                  16, 10).cast("bigint")


def hash_bucket(seed: int | str, key: str | Column, k: int) -> Column:
    return F.pmod(hash_u32(seed, key), F.lit(k))


def hash_unit(seed: int | str, key: str | Column) -> Column:
    """Uniform value in [0, 1) derived from the portable hash."""
    return hash_u32(seed, key) / F.lit(4294967296.0)


def r6(c: Column, digits: int = 6) -> Column:
    """Round for engine-independent comparison; -0.0 folded to 0.0."""
    return F.round(c, digits) + F.lit(0.0)


def normal_cdf(z: Column) -> Column:
    """Φ(z) by the Abramowitz–Stegun 7.1.26 erf approximation (|err| < 1.5e-7)."""
    x = F.abs(z) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.3275911) * x)
    poly = t * (F.lit(0.254829592) + t * (F.lit(-0.284496736) + t * (
        F.lit(1.421413741) + t * (F.lit(-1.453152027) + t * F.lit(1.061405429)))))
    erf = F.lit(1.0) - poly * F.exp(-x * x)
    return F.when(z >= 0, (F.lit(1.0) + erf) / 2).otherwise((F.lit(1.0) - erf) / 2)


def normal_pdf(z: Column) -> Column:
    return F.exp(-z * z / 2) / F.lit((2 * 3.141592653589793) ** 0.5)


def round_sig(c: Column, digits: int = 9) -> Column:
    """Round to ``digits`` significant digits (engine-independent compare of
    large aggregates).  SQL twin: ``plans.common.sig``."""
    e = F.floor(F.log10(F.abs(c)))
    scale = F.pow(F.lit(10.0), e - F.lit(digits - 1))
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c / scale, 0) * scale) + F.lit(0.0)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson over pairwise-complete rows; null (not an ANSI error) when a
    column is constant."""
    xm = F.when(y.isNotNull(), x.cast("double"))
    ym = F.when(x.isNotNull(), y.cast("double"))
    return F.try_divide(F.covar_samp(xm, ym), F.stddev_samp(xm) * F.stddev_samp(ym))
