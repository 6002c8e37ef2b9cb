"""Table stores over parquet snapshots (A09–A23): entity upsert and search,
partial updates, long measurement tables, a feature store, dataset
versions, and log queries.  Writes always go to a new snapshot folder,
never over the path being read."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path


def entity_id(key: str | F.Column) -> F.Column:
    """First 16 hex digits of md5(key)."""
    k = F.col(key) if isinstance(key, str) else key
    return F.substring(F.md5(k.cast("string")), 1, 16)


def upsert(base: DataFrame, updates: DataFrame, key: str, seq_col: str) -> DataFrame:
    """Union, then last write per key wins (largest ``seq_col``).
    ``max_by`` is partially aggregated, so a hot key costs one struct per
    partition rather than a skewed sort."""
    cols = [c for c in base.columns]
    u = base.unionByName(updates, allowMissingColumns=True).withColumn("id", entity_id(key))
    rec = F.struct(*[F.col(c) for c in cols if c != "id"])
    return (u.groupBy("id").agg(F.max_by(rec, F.col(seq_col)).alias("r"))
            .select("id", "r.*"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """A10: point lookup (pushed into the parquet scan)."""
    return df.where(F.col(key) == F.lit(value))


def search(df: DataFrame, id_col: str, tags_col: str | None = None, tags: Sequence[str] = (),
           num_col: str | None = None, num_range: tuple[float, float] | None = None,
           name_col: str | None = None, name_pattern: str | None = None,
           limit: int = 100) -> DataFrame:
    """Every tag present, inclusive numeric range, case-insensitive
    name contains; deterministic LIMIT by id (TakeOrderedAndProject)."""
    out = df
    if tags_col and tags:
        out = out.where(F.forall(F.array(*[F.lit(t) for t in tags]),
                                 lambda t: F.array_contains(F.col(tags_col), t)))
    if num_col and num_range:
        out = out.where(F.col(num_col).between(num_range[0], num_range[1]))
    if name_col and name_pattern:
        out = out.where(F.col(name_col).ilike(f"%{name_pattern}%"))
    return out.orderBy(id_col).limit(limit)


def newest_first(df: DataFrame, ts_col: str, id_col: str) -> DataFrame:
    """All rows, newest first (range-partitioned distributed sort)."""
    return df.orderBy(F.desc(ts_col), F.desc(id_col))


def partial_update(base: DataFrame, patch: DataFrame, id_col: str,
                   fields: Sequence[str], ts_col: str, ts_value) -> DataFrame:
    """Only supplied (non-null) fields change; the timestamp is set on
    every patched row.  One left join on the id."""
    p = patch.select(id_col, *[F.col(c).alias(f"__p_{c}") for c in fields]).withColumn("__hit", F.lit(True))
    j = base.join(p, id_col, "left")
    sets = {c: F.coalesce(F.col(f"__p_{c}"), F.col(c)) for c in fields}
    sets[ts_col] = F.when(F.col("__hit"), F.lit(ts_value)).otherwise(F.col(ts_col)) \
        if ts_col in base.columns else F.when(F.col("__hit"), F.lit(ts_value))
    return j.withColumns(sets).drop("__hit", *[f"__p_{c}" for c in fields])


def append_measurements(parents: DataFrame, parent_key: str, values: DataFrame,
                        value_key: str, value_col: str, run_id: str, prop: str,
                        uncertainty_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Get-or-create parents (anti join of referenced keys), then the
    long table (entity_id, run_id, property, value, uncertainty)."""
    refs = values.select(F.col(value_key).alias(parent_key)).distinct()
    new = refs.join(parents.select(parent_key), parent_key, "left_anti")
    all_parents = (parents.select(parent_key).withColumn("is_new", F.lit(False))
                   .unionByName(new.withColumn("is_new", F.lit(True))))
    long = values.select(F.col(value_key).alias("entity_id"), F.lit(run_id).alias("run_id"),
                         F.lit(prop).alias("property"), F.col(value_col).cast("double").alias("value"),
                         (F.col(uncertainty_col).cast("double") if uncertainty_col
                          else F.lit(None).cast("double")).alias("uncertainty"))
    return all_parents, long


def flatten_map(df: DataFrame, map_col: str, keys: Sequence[str] | None = None,
                prefix: str = "") -> DataFrame:
    """Map → one column per key.  Keys come from the caller or from one
    distinct pass over ``map_keys`` (bounded: keys, not rows)."""
    if keys is None:
        keys = sorted(r[0] for r in df.select(F.explode(F.map_keys(map_col))).distinct().collect())
    return df.select(*[c for c in df.columns if c != map_col],
                     *[F.col(map_col).getItem(k).alias(prefix + k) for k in keys])


def join_tags(tags_col: str) -> F.Column:
    return F.concat_ws(",", F.col(tags_col))


# ---------------------------------------------------------------- feature store
class Catalog:
    """A table of small rows that is only ever appended to: a folder of Parquet files
    beside the data, so that any process that knows the folder can open the store."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, f"{schema}, at bigint"
        spark.createDataFrame([], self.schema).write.mode("append").parquet(path)

    def append(self, rows: list[tuple]) -> None:
        at = time.time_ns()
        self.spark.createDataFrame([(*r, at) for r in rows], self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


class FeatureStore:
    """Groups are parquet folders; their definitions (schema, descriptions,
    numbers of rows and values) are a catalog table, of which the last registration of
    a group holds."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or scratch_path(spark, "features")
        self._defs = Catalog(spark, f"{self.root}/definitions-catalog", '`group` string, place int, name string, dtype string, '
                             'description string, entity string, path string, n_rows bigint, n_values bigint')

    def register(self, group: str, df: DataFrame, entity_column: str = "id",
                 definitions: dict[str, str] | None = None) -> str:
        if entity_column not in df.columns:
            raise ValueError(f"entity column '{entity_column}' missing")
        # A folder of its own: readers of the last registration keep theirs.
        path = f"{self.root}/{group}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        names = [f for f in df.schema.fields if f.name != entity_column]
        n = self.spark.read.schema(df.schema).parquet(path).agg(F.count("*"), *[F.count(F.col(f"`{f.name}`")) for f in names]).first()
        definitions = definitions or {}
        self._defs.append([(group, -1, None, None, None, entity_column, path, n[0], None)] + [
            (group, i, f.name, f.dataType.simpleString(), definitions.get(f.name, ""), entity_column, path, n[0], n[i + 1])
            for i, f in enumerate(names)])
        return path

    def _current(self) -> DataFrame:
        every = self._defs.read()
        last = every.groupBy("group").agg(F.max("at").alias("at"))
        return every.join(last, ["group", "at"])

    def get(self, group: str, feature_names: Sequence[str] | None = None,
            entity_ids: DataFrame | None = None) -> DataFrame:
        row = self._current().where(F.col("group") == group).select("entity", "path").first()
        if row is None:
            raise KeyError(f"feature group '{group}' not found")
        ent = row["entity"]
        df = self.spark.read.parquet(row["path"])
        if entity_ids is not None:
            df = df.join(entity_ids.select(F.col(entity_ids.columns[0]).alias(ent)), ent, "left_semi")
        if feature_names is not None:
            keep = [c for c in feature_names if c in df.columns and c != ent]
            df = df.select(ent, *keep)
        return df

    def definitions(self, group: str | None = None) -> DataFrame:
        rows = self._current().where("place >= 0")
        if group is not None:
            rows = rows.where(F.col("group") == group)
        return rows.select("group", "name", "dtype", "description", "n_rows", "n_values")

    def search(self, text: str) -> DataFrame:
        return self.definitions().where(F.lower("name").contains(text.lower()))

    def list_groups(self) -> list[str]:
        return sorted(r[0] for r in self._defs.read().select("group").distinct().collect())


# ---------------------------------------------------------------- versions
def content_hash(df: DataFrame) -> DataFrame:
    """Order-independent content hash: (count, Σ xxhash64(row) as decimal)."""
    h = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).alias("h"))


class DataVersions:
    """Snapshot folders v1, v2, … and a catalog table of versions.  Two
    processes cannot commit the same version: its folder must be new."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = root or scratch_path(spark, "versions")
        self._catalog = Catalog(spark, f"{self.root}/versions-catalog", "name string, version int, hash string, n_rows bigint, n_cols int, "
                                "`schema` string, description string")

    def _versions(self, name: str) -> DataFrame:
        return self._catalog.read().where(F.col("name") == name)

    def commit(self, name: str, df: DataFrame, description: str = "") -> int:
        hrow = content_hash(df).first()
        digest = f"{hrow['n_rows']}:{hrow['h']}:{','.join(df.columns)}"
        last = self._versions(name).orderBy(F.desc("version")).select("version", "hash").first()
        if last and last["hash"] == digest:
            return last["version"]
        v = last["version"] + 1 if last else 1
        df.write.mode("errorifexists").parquet(f"{self.root}/{name}/v{v}")
        self._catalog.append([(name, v, digest, int(hrow["n_rows"]), len(df.columns), df.schema.json(), description)])
        return v

    def checkout(self, name: str, version: int | None = None) -> DataFrame:
        found = self._versions(name) if version is None else self._versions(name).where(F.col("version") == version)
        v = found.agg(F.max("version")).first()[0]
        if v is None:
            raise KeyError(name if version is None else f"{name} v{version}")
        return self.spark.read.parquet(f"{self.root}/{name}/v{v}")

    def list_versions(self, name: str) -> DataFrame:
        return self._versions(name).select("version", "n_rows", "n_cols", "description")

    def diff(self, name: str, v1: int, v2: int) -> DataFrame:
        return table_diff(self.checkout(name, v1), self.checkout(name, v2))


def table_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Row-count delta, columns added/removed, rows added/removed
    (multiset difference both ways on the shared columns)."""
    shared = [c for c in a.columns if c in b.columns]
    added_cols = [c for c in b.columns if c not in a.columns]
    removed_cols = [c for c in a.columns if c not in b.columns]
    sa, sb = a.select(*shared), b.select(*shared)
    na = a.agg(F.count(F.lit(1)).alias("rows_v1"))
    nb = b.agg(F.count(F.lit(1)).alias("rows_v2"))
    add = sb.exceptAll(sa).agg(F.count(F.lit(1)).alias("added_rows"))
    rem = sa.exceptAll(sb).agg(F.count(F.lit(1)).alias("removed_rows"))
    from ..functions.bind import bind_stats
    row = na
    for o in (nb, add, rem):
        row = bind_stats(row, o, "_o").select(*row.columns, *[F.col(f"_o.{c}").alias(c) for c in o.columns])
    return row.select("rows_v1", "rows_v2", (F.col("rows_v2") - F.col("rows_v1")).alias("row_delta"),
                      "added_rows", "removed_rows",
                      F.lit(",".join(added_cols)).alias("columns_added"),
                      F.lit(",".join(removed_cols)).alias("columns_removed"))


# ---------------------------------------------------------------- logs
def job_list(jobs: DataFrame, ts_col: str, id_col: str, experiment_col: str | None = None,
             experiment=None, status_col: str | None = None, status=None) -> DataFrame:
    """Filter by experiment / status, newest first."""
    out = jobs
    if experiment_col and experiment is not None:
        out = out.where(F.col(experiment_col) == F.lit(experiment))
    if status_col and status is not None:
        out = out.where(F.col(status_col) == F.lit(status))
    return out.orderBy(F.desc(ts_col), F.desc(id_col))


def job_statistics(jobs: DataFrame, status_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Totals, completed, failed (optionally per group)."""
    aggs = [F.count(F.lit(1)).alias("total_jobs"),
            F.count_if(F.col(status_col) == "completed").alias("completed"),
            F.count_if(F.col(status_col) == "failed").alias("failed")]
    return jobs.groupBy(*group_cols).agg(*aggs)


def audit_query(log: DataFrame, ts_col: str, user_col: str, action_col: str,
                user=None, action=None, limit: int = 100, id_col: str | None = None) -> DataFrame:
    """Filter user / action, last N by time."""
    out = log
    if user is not None:
        out = out.where(F.col(user_col) == F.lit(user))
    if action is not None:
        out = out.where(F.col(action_col) == F.lit(action))
    order = [F.desc(ts_col)] + ([F.desc(id_col)] if id_col else [])
    return out.orderBy(*order).limit(limit)


PROPS_SCHEMA = T.MapType(T.StringType(), T.DoubleType())
