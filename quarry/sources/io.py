"""File sources and sinks.

Readers never infer types with an extra pass unless asked: they read
strings and cast to the declared types, so a 100 TB CSV is scanned once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalise_names(df: DataFrame) -> DataFrame:
    """Column names trimmed and lower-cased."""
    return df.toDF(*[c.strip().lower() for c in df.columns])


def _typed(df: DataFrame, types: Mapping[str, str] | None) -> DataFrame:
    if not types:
        return df
    return df.select(*[F.col(c).try_cast(types[c]).alias(c) if c in types else F.col(c) for c in df.columns])


def _require(df: DataFrame, key_column: str | None) -> DataFrame:
    if key_column is not None and key_column not in df.columns:
        raise ValueError(f"key column '{key_column}' not found; columns: {df.columns}")
    return df


def read_csv(spark: SparkSession, path: str, key_column: str | None = None,
             types: Mapping[str, str] | None = None, sep: str = ",",
             infer: bool = False) -> DataFrame:
    """Header CSV/TSV; names normalised; optional declared types
    (``try_cast``: bad cells become null instead of failing the job)."""
    df = spark.read.csv(path, header=True, sep=sep, inferSchema=infer, multiLine=False)
    return _require(_typed(normalise_names(df), types), key_column)


def read_tsv(spark: SparkSession, path: str, key_column: str | None = None,
             types: Mapping[str, str] | None = None) -> DataFrame:
    return read_csv(spark, path, key_column, types, sep="\t")


def read_json(spark: SparkSession, path: str, key_column: str | None = None,
              wrapper: str = "molecules", multiline: bool = True,
              schema: T.StructType | str | None = None) -> DataFrame:
    """Array of records, a ``{wrapper: [...]}`` object, or one object."""
    r = spark.read.option("multiLine", multiline)
    if schema is not None:
        r = r.schema(schema)
    df = r.json(path)
    f = df.schema.fields
    if len(f) == 1 and f[0].name == wrapper and isinstance(f[0].dataType, T.ArrayType):
        df = df.select(F.inline(wrapper))
    return _require(normalise_names(df), key_column)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str,
               key_column: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines).  Lines are parsed with ``from_json`` in
    PERMISSIVE mode; a line that is not a JSON object lands in the error
    frame with its file, line number (from 1, empty lines counted) and text, good
    lines continue."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    # The lines of a block of a file follow each other in its task.
    every = spark.read.text(path).select(
        F.col("value").alias("line"), F.input_file_name().alias("file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__at"))
    raw = every.where(F.length(F.trim("line")) > 0)
    bad_field = "__malformed"
    wide = T.StructType([*schema.fields, T.StructField(bad_field, T.StringType())])
    parsed = raw.withColumn("rec", F.from_json("line", wide, {"mode": "PERMISSIVE",
                                                              "columnNameOfCorruptRecord": bad_field}))
    ok = (F.col("rec").isNotNull() & F.col(f"rec.{bad_field}").isNull()
          & F.trim("line").startswith("{") & F.trim("line").endswith("}"))
    good = parsed.where(ok).select("rec.*").drop(bad_field)
    # A row per block: as many as the scan has splits.
    blocks = every.groupBy("file", "__block").agg(F.min("__at").alias("__first"), F.count("*").alias("__lines"))
    w = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__lines").over(w), F.lit(0)))
    bad = (parsed.where(~ok).join(blocks, ["file", "__block"])
           .select("file", (F.col("__before") + F.col("__at") - F.col("__first") + 1).alias("line_number"), "line",
                   F.lit("invalid json").alias("error")))
    return _require(good, key_column), bad


# ---------------------------------------------------------------- A05 / A08
def read_records(spark: SparkSession, path: str, property_names: Sequence[str] | None = None,
                 separator: str = "$$$$") -> DataFrame:
    """Multi-record text (``$$$$``-terminated blocks, ``> <NAME>`` then a
    value line).  Output (title, properties map<string,string>, is_valid);
    the optional whitelist keeps only named properties.  Each record is
    one row of a line-separator scan, so files split across tasks."""
    df = spark.read.option("lineSep", separator + "\n").text(path)
    body = F.regexp_replace(F.col("value"), r"^\n+", "")
    names = F.regexp_extract_all(body, F.lit(r"> *<([^>\n]+)>[^\n]*\n([^\n]*)"), 1)
    vals = F.regexp_extract_all(body, F.lit(r"> *<([^>\n]+)>[^\n]*\n([^\n]*)"), 2)
    # A repeated property name keeps its last value.
    entries = F.transform(names, lambda n, i: F.struct(
        n.alias("key"), F.get(vals, i).alias("value"),
        (F.array_position(F.reverse(names), n) == F.size(names) - i).alias("last")))
    props = F.map_from_entries(F.transform(F.filter(entries, lambda e: e["last"]),
                                           lambda e: F.struct(e["key"], e["value"])))
    if property_names:
        keep = F.array(*[F.lit(p) for p in property_names])
        props = F.map_filter(props, lambda k, v: F.array_contains(keep, k))
    title = F.split(body, "\n").getItem(0)
    return (df.where(F.length(F.trim("value")) > 0)
            .select(title.alias("title"), props.alias("properties"),
                    (F.length(F.trim(title)) > 0).alias("is_valid")))


def write_records(df: DataFrame, path: str, title_col: str,
                  property_cols: Sequence[str], separator: str = "$$$$") -> None:
    """One block per row; null properties are skipped."""
    blocks = F.array_compact(F.array(*[
        F.when(F.col(c).isNotNull(), F.concat(F.lit(f"> <{c.upper()}>\n"), F.col(c).cast("string"), F.lit("\n")))
        for c in property_cols]))
    text = F.concat(F.coalesce(F.col(title_col).cast("string"), F.lit("")), F.lit("\n"),
                    F.array_join(blocks, "\n"), F.lit("\n"))
    df.select(text.alias("value")).write.mode("overwrite").option("lineSep", separator + "\n").text(path)


# ---------------------------------------------------------------- A06 / A07
_FORMATS = {"csv": "csv", "tsv": "tsv", "txt": "tsv", "json": "json",
            "jsonl": "jsonl", "ndjson": "jsonl", "parquet": "parquet"}


def format_of(path: str, fmt: str | None = None) -> str:
    """Explicit format wins; else by suffix; unknown raises ValueError."""
    if fmt:
        if fmt not in _FORMATS.values():
            raise ValueError(f"unsupported format: {fmt}")
        return fmt
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix not in _FORMATS:
        raise ValueError(f"unsupported file type: {path}")
    return _FORMATS[suffix]


def import_data(spark: SparkSession, path: str, key_column: str | None = None,
                fmt: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    f = format_of(path, fmt)
    if f == "csv":
        return read_csv(spark, path, key_column)
    if f == "tsv":
        return read_tsv(spark, path, key_column)
    if f == "json":
        return read_json(spark, path, key_column, schema=schema)
    if f == "jsonl":
        if schema is None:
            schema = spark.read.json(path).schema
        return read_jsonl(spark, path, schema, key_column)[0]
    return _require(spark.read.parquet(path), key_column)


def export_data(df: DataFrame, path: str, fmt: str | None = None) -> None:
    """Csv / tsv (header, no index), json / jsonl (one record per line),
    parquet.  Output is one directory of part files."""
    f = format_of(path, fmt)
    w = df.write.mode("overwrite")
    if f == "csv":
        w.option("header", True).csv(path)
    elif f == "tsv":
        w.option("header", True).option("sep", "\t").csv(path)
    elif f in ("json", "jsonl"):
        w.json(path)
    else:
        w.parquet(path)


# ---------------------------------------------------------------- A08
def record_blocks(df, name_col: str, prop_cols, terminator: str = "$$$$"):
    """A08 (SDF writer re-aimed): one text block per row — the name line,
    then '>  <prop>' + value for every non-null property, then the
    terminator.  ``concat_ws`` skips nulls, so missing properties vanish."""
    from pyspark.sql import functions as F
    parts = [F.col(name_col).cast("string")]
    parts += [F.when(F.col(c).isNotNull(), F.concat(F.lit(f">  <{c}>\n"), F.col(c).cast("string"), F.lit("\n")))
              for c in prop_cols]
    return F.concat_ws("\n", *parts, F.lit(terminator))


def export_blocks(df, path: str, name_col: str, prop_cols, terminator: str = "$$$$") -> None:
    """Write the blocks as text, one block per row (distributed write)."""
    from pyspark.sql import functions as F
    df.select(record_blocks(df, name_col, prop_cols, terminator).alias("value")).write.mode("overwrite").text(path)


def read_blocks(spark, path: str, terminator: str = "$$$$"):
    """Read blocks back: records split on the terminator line."""
    from pyspark.sql import functions as F
    r = spark.read.option("lineSep", terminator + "\n").text(path)
    return r.where(F.length(F.trim("value")) > 0).select(F.concat(F.col("value"), F.lit(terminator)).alias("record"))
