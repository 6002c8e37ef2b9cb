"""Schema detection and validation (B01–B11).  Detection inspects the
schema on the driver and the data with one aggregate; validators are
boolean Columns so they stay inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import INTEGRAL, NUMERIC, is_missing, numeric_columns, string_columns

# fixed value: the key-string alphabet of the reference's detector
KEY_ALPHABET = "CNOPSFIBrcnopsfibl[]()=#@+-0123456789"
KEY_NAME_CANDIDATES = ("smiles", "SMILES", "Smiles", "canonical_smiles", "mol", "molecule")


def alphabet_regex(alphabet: str = KEY_ALPHABET) -> str:
    esc = "".join("\\" + c if c in "[]\\^-" else c for c in alphabet)
    return f"^[{esc}]+$"


def key_column_scores(df: DataFrame, order_col: str, pattern: str | None = None) -> DataFrame:
    """Per string column but ``order_col``, whether all its non-null
    values match the key alphabet → (column_name, position, looks_like_key).
    One aggregate over the whole table; a column without values is no key."""
    pattern = pattern or alphabet_regex()
    cols = string_columns(df, [order_col])
    one = df.agg(F.lit(0).alias("__none"),
                 *[F.coalesce(F.bool_and(F.col(c).rlike(pattern)), F.lit(False)).alias(f"__k{i}")
                   for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                     F.col(f"__k{i}").alias("looks_like_key")) for i, c in enumerate(cols)]
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, position int, looks_like_key boolean")
    return one.select(F.inline(F.array(*rows)))


def detect_key_column(df: DataFrame, order_col: str, candidates: Sequence[str] = KEY_NAME_CANDIDATES) -> DataFrame:
    """A candidate name wins; else the first string column all of whose
    values look like keys.  One-row frame (key_column)."""
    for c in candidates:
        if c in df.columns:
            return df.sparkSession.createDataFrame([(c,)], "key_column string")
    return (key_column_scores(df, order_col).where("looks_like_key")
            .agg(F.min_by("column_name", "position").alias("key_column")))


def key_columns_by_validity(df: DataFrame, order_col: str, validator, name_token: str = "smiles",
                            min_rate: float = 0.8) -> DataFrame:
    """String columns whose name contains the token or whose non-null
    values pass ``validator(col)`` at a rate above ``min_rate``; one aggregate
    over the whole table.  Without values the rate is null."""
    cols = string_columns(df, [order_col])
    one = df.agg(F.lit(0).alias("__none"),
                 *[F.avg(F.when(F.col(c).isNotNull(), validator(F.col(c)).cast("double"))).alias(f"__r{i}")
                   for i, c in enumerate(cols)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"__r{i}").alias("valid_rate"),
                     (F.lit(name_token.lower() in c.lower()) | (F.col(f"__r{i}") > min_rate)).alias("is_key"))
            for i, c in enumerate(cols)]
    if not rows:
        return df.sparkSession.createDataFrame([], "column_name string, valid_rate double, is_key boolean")
    return one.select(F.inline(F.array(*rows)))


def prepare_xy(df: DataFrame, target: str, key_col: str | None = None,
               feature_cols: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """(key, features..., target); default features are the numeric
    columns other than the target, key and exclusions."""
    if target not in df.columns:
        raise ValueError(f"target column '{target}' not found")
    feats = list(feature_cols) if feature_cols else numeric_columns(df, [target, *( [key_col] if key_col else []), *exclude])
    cols = ([key_col] if key_col else []) + feats + [target]
    return df.select(*cols)


def column_types(df: DataFrame, skip: Sequence[str] = (), binary_max: int = 2,
                 count_max: int = 20) -> DataFrame:
    """Binary / integer_count / continuous / categorical per column
    (distinct counts exclude nulls; one aggregate)."""
    cols = [c for c in df.columns if c not in set(skip)]
    one = df.agg(*[F.count_distinct(c).alias(c) for c in cols])
    structs = []
    for c in cols:
        dt = df.schema[c].dataType
        n = F.col(c)
        if isinstance(dt, NUMERIC):
            kind = (F.when(n <= binary_max, "binary")
                    .when(F.lit(isinstance(dt, INTEGRAL)) & (n <= count_max), "integer_count")
                    .otherwise("continuous"))
        else:
            kind = F.when(n <= binary_max, "binary").otherwise("categorical")
        structs.append(F.struct(F.lit(c).alias("column_name"), n.cast("bigint").alias("n_distinct"),
                                kind.alias("column_type")))
    return one.select(F.inline(F.array(*structs)))


def column_types_alt(df: DataFrame, skip: Sequence[str] = (), limit: int = 10) -> DataFrame:
    """continuous = numeric with > limit distinct; categorical = string
    or < limit distinct; exactly ``limit`` distinct numeric → neither."""
    cols = [c for c in df.columns if c not in set(skip)]
    one = df.agg(*[F.count_distinct(c).alias(c) for c in cols])
    structs = []
    for c in cols:
        dt = df.schema[c].dataType
        n = F.col(c)
        num = isinstance(dt, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType))
        isstr = isinstance(dt, T.StringType)
        kind = (F.when(F.lit(num) & (n > limit), "continuous")
                .when(F.lit(isstr) | (n < limit), "categorical"))
        structs.append(F.struct(F.lit(c).alias("column_name"), n.cast("bigint").alias("n_distinct"),
                                kind.alias("column_type")))
    return one.select(F.inline(F.array(*structs)))


def detect_task_type(df: DataFrame, key_col: str | None = None, ratio_col: str | None = None) -> str:
    """Schema-only task detection."""
    has_key = key_col is not None and key_col in df.columns
    has_ratio = ratio_col is not None and ratio_col in df.columns
    others = numeric_columns(df, [c for c in (key_col, ratio_col) if c])
    if has_key and has_ratio:
        return "mixture"
    if has_key and others:
        return "key_tabular"
    if has_key:
        return "key_only"
    return "tabular"


def validate_table(df: DataFrame, required: Sequence[str] = (), numeric: Sequence[str] = (),
                   missing_warn: float = 10.0, dup_warn: float = 5.0, min_rows: int = 1) -> DataFrame:
    """(level, code, value) issues.  Schema errors are decided on the
    driver; empty / missing / duplicate checks are one aggregate plus one
    duplicate group-by."""
    spark = df.sparkSession
    issues = [("error", f"missing_column:{c}", None) for c in required if c not in df.columns]
    issues += [("error", f"not_numeric:{c}", None) for c in numeric
               if c in df.columns and not isinstance(df.schema[c].dataType, NUMERIC)]
    static = spark.createDataFrame(issues, "level string, code string, value double")
    cells = sum((F.count_if(is_missing(c, df.schema[c].dataType)) for c in df.columns), F.lit(0))
    st = df.agg(F.count(F.lit(1)).alias("__n"), cells.alias("__m"))
    dups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__c")).agg(
        F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).alias("__d"))
    from ..functions.bind import bind_stats
    row = bind_stats(st, dups, "_d")
    pct_m = F.try_divide(F.col("__m"), F.col("__n") * F.lit(max(len(df.columns), 1))) * 100
    pct_d = F.try_divide(F.col("_d.__d"), F.col("__n")) * 100
    dyn = row.select(F.inline(F.array(
        F.struct(F.lit("error").alias("level"), F.lit("too_few_rows").alias("code"),
                 F.col("__n").cast("double").alias("value"), (F.col("__n") < min_rows).alias("hit")),
        F.struct(F.lit("warning").alias("level"), F.lit("high_missing_rate").alias("code"),
                 pct_m.cast("double").alias("value"), ((F.col("__n") > 0) & (pct_m > missing_warn)).alias("hit")),
        F.struct(F.lit("warning").alias("level"), F.lit("duplicates").alias("code"),
                 pct_d.cast("double").alias("value"), ((F.col("__n") > 0) & (pct_d > dup_warn)).alias("hit")),
    ))).where("hit").drop("hit")
    return static.unionByName(dyn)


def split_valid(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows + first failing reason).  ``checks``
    are (reason, passes) pairs evaluated in order."""
    reason = F.lit(None).cast("string")
    for name, ok in reversed(list(checks)):
        reason = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(reason)
    tagged = df.withColumn("reject_reason", reason)
    return tagged.where(F.col("reject_reason").isNull()).drop("reject_reason"), \
        tagged.where(F.col("reject_reason").isNotNull())


def validity_summary(df: DataFrame, checks: Sequence[tuple[str, Column]]) -> DataFrame:
    """Totals, successful, failed and success_rate (0 when empty) in one pass."""
    ok = F.lit(True)
    for _, c in checks:
        ok = ok & F.coalesce(c, F.lit(False))
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful")).select(
        "total", "successful", (F.col("total") - F.col("successful")).alias("failed"),
        F.when(F.col("total") > 0, F.col("successful") / F.col("total")).otherwise(F.lit(0.0)).alias("success_rate"))


def numeric_rule(value: Column, min_value: float | None = None, max_value: float | None = None,
                 allow_none: bool = False) -> Column:
    """B09: 'ok' or the first violation: null / not_numeric / below_min / above_max."""
    v = value.cast("string").try_cast("double")
    out = F.when(value.isNull(), F.lit("ok" if allow_none else "null")) \
        .when(v.isNull(), F.lit("not_numeric"))
    if min_value is not None:
        out = out.when(v < F.lit(min_value), F.lit("below_min"))
    if max_value is not None:
        out = out.when(v > F.lit(max_value), F.lit("above_max"))
    return out.otherwise(F.lit("ok"))


def rule_violations(rules: Sequence[dict]) -> Column:
    """Rule list (column, required, type, min, max, choices) → array of
    violation codes per row."""
    codes = []
    for r in rules:
        c = F.col(r["column"])
        name = r["column"]
        if r.get("required"):
            codes.append(F.when(c.isNull(), F.lit(f"{name}:required")))
        if r.get("type") in ("int", "double", "bigint"):
            codes.append(F.when(c.isNotNull() & c.cast("string").try_cast(r["type"]).isNull(),
                                F.lit(f"{name}:type")))
        if r.get("min") is not None:
            codes.append(F.when(c < F.lit(r["min"]), F.lit(f"{name}:min")))
        if r.get("max") is not None:
            codes.append(F.when(c > F.lit(r["max"]), F.lit(f"{name}:max")))
        if r.get("choices"):
            codes.append(F.when(c.isNotNull() & ~c.isin(list(r["choices"])), F.lit(f"{name}:choices")))
    return F.array_compact(F.array(*codes))


# fixed values: allowed characters and dangerous patterns of the input guard
SANITIZE_ALLOWED = "CNOSPFClBrI[]()=#-+@/\\0123456789cnops"
DANGEROUS_PATTERNS = [r"<script", r"javascript:", r"on\w+=", r"\$\{", r"\{\{"]


def sanitize(col: Column, max_len: int = 500) -> Column:
    """Keep allow-listed characters only, cut at ``max_len``."""
    cls = "".join("\\" + ch if ch in "[]\\^-" else ch for ch in sorted(set(SANITIZE_ALLOWED)))
    return F.substring(F.regexp_replace(col, f"[^{cls}]", ""), 1, max_len)


def is_safe_input(col: Column, max_length: int = 1000) -> Column:
    """Non-empty, not over-long, no dangerous pattern (case-insensitive)."""
    pat = "(?i)(" + "|".join(DANGEROUS_PATTERNS) + ")"
    return (F.coalesce(F.length(col), F.lit(0)) > 0) & (F.length(col) <= max_length) & ~col.rlike(pat)
