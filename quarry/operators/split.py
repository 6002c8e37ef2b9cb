"""Reproducible splits and sampling.

Randomness is a portable md5 bucket of (seed, key): the same row lands in
the same fold on any partitioning, on any rerun, and in DuckDB.  Ordered
assignments (strata, groups, time) use ``global_rank`` so no window ever
collects a whole table or a whole class into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hash_bucket, hash_u32, hash_unit
from ..functions.stats import global_rank, ntile_of


def kfold(df: DataFrame, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """fold = md5-bucket(seed, key) mod k."""
    return df.withColumn("fold", hash_bucket(seed, key, k).cast("int"))


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Within each class rows are ordered by the seeded hash and dealt
    round-robin: fold = (rank − 1) mod k."""
    x = df.withColumn("__h", hash_u32(seed, key))
    r = global_rank(x, ["__h", key], [label])
    return r.withColumn("fold", ((F.col("__rn") - 1) % k).cast("int")).drop("__h", "__rn", "__cum", "__n", "__wt")


def _serpentine(pos: F.Column, k: int) -> F.Column:
    rnd = F.floor(pos / k)
    return F.when(rnd % 2 == 0, pos % k).otherwise(k - 1 - pos % k).cast("int")


def group_kfold(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Groups never split; groups sorted by size desc (then key) are
    dealt in a serpentine so fold sizes stay balanced.  Works on the group
    table (one row per group), then joins back."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size")).withColumn("__neg", -F.col("__size"))
    r = global_rank(sizes, ["__neg", group])
    folds = r.select(group, _serpentine(F.col("__rn") - 1, k).alias("fold"))
    return df.join(folds, group)


def leave_one_group_out(df: DataFrame, group: str) -> DataFrame:
    """fold = dense rank of the group (0-based)."""
    g = global_rank(df.select(group).distinct(), [group]).select(group, (F.col("__rn") - 1).cast("int").alias("fold"))
    return df.join(g, group)


def _deal_class(load: list[int], size: int, count: int) -> list[tuple[int, int, list[int]]]:
    """Deals ``count`` groups of one ``size``, each to the fold of least load
    (ties: smaller fold), and adds them to ``load``.  Fold i takes its j-th
    group when its load stands at load_i + j·size, so groups go out in levels:
    fold i joins at level (load_i − min) div size, and within a level the folds
    follow their remainders.  Returns (first position, end, folds in turn)."""
    base = min(load)
    level = [(x - base) // size for x in load]
    turn = sorted(range(len(load)), key=lambda i: ((load[i] - base) % size, i))
    out, pos = [], 0
    starts = sorted(set(level))
    for at, nxt in zip(starts, [*starts[1:], None]):
        folds = [i for i in turn if level[i] <= at]
        n = count - pos if nxt is None else min(count - pos, (nxt - at) * len(folds))
        if n:
            out.append((pos, pos + n, folds))
            for j, i in enumerate(folds):
                load[i] += size * (n // len(folds) + (j < n % len(folds)))
        pos += n
    return out


def group_lpt(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Each group (largest first, then by key) goes to the currently
    smallest fold.  Groups of one size are interchangeable, so the greedy pass
    on the driver sees the distinct sizes only (at most about the root of twice
    the rows); a group finds its fold by its rank among the groups of its size."""
    spark = df.sparkSession
    sizes = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__size"))
    ranked = global_rank(sizes, ["__g"], ["__size"]).select("__g", "__size", (F.col("__rn") - 1).alias("__pos"))
    classes = sizes.groupBy("__size").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("__size")).collect()
    load = [0] * k
    deals = [(r["__size"], _deal_class(load, r["__size"], r["c"])) for r in classes]
    plan = spark.createDataFrame(deals, "__size bigint, __runs array<struct<a: bigint, b: bigint, folds: array<int>>>")
    run = F.filter("__runs", lambda x: (F.col("__pos") >= x["a"]) & (F.col("__pos") < x["b"]))[0]
    folds = (ranked.join(plan, "__size").withColumn("__run", run)
             .select("__g", F.col("__run.folds")[((F.col("__pos") - F.col("__run.a"))
                                                  % F.size("__run.folds")).cast("int")].alias("fold")))
    return df.join(folds, F.col(group).eqNullSafe(F.col("__g"))).drop("__g")


def group_shuffle_split(df: DataFrame, group: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Groups in seeded-hash order fill the test side while the rows
    already taken are below test_size · n; the rest is train."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__size")).withColumn("__h", hash_u32(seed, group))
    r = global_rank(sizes, ["__h", group], weight_col="__size")
    taken_before = F.col("__cum") - F.col("__size")
    g = r.select(group, F.when(taken_before < F.lit(test_size) * F.col("__wt"), "test").otherwise("train").alias("split"))
    return df.join(g, group)


def time_series_split(df: DataFrame, ts: str, key: str, n_splits: int = 5) -> DataFrame:
    """tile = ntile(n_splits+1) over (ts, key); split i trains on tiles
    ≤ i and tests on tile i+1."""
    r = global_rank(df, [ts, key])
    return r.withColumn("tile", ntile_of(F.col("__rn") - 1, F.col("__n"), n_splits + 1)) \
        .drop("__rn", "__cum", "__n", "__wt")


def time_series_folds(tiled: DataFrame, n_splits: int = 5) -> DataFrame:
    """Explode tiles into (split, role) membership."""
    x = tiled.withColumn("split", F.explode(F.sequence(F.lit(1), F.lit(n_splits))))
    x = x.where(F.col("tile") <= F.col("split") + 1)
    return x.withColumn("role", F.when(F.col("tile") == F.col("split") + 1, "test").otherwise("train"))


def repeated_kfold(df: DataFrame, key: str, k: int = 5, repeats: int = 10, seed: int = 42) -> DataFrame:
    """One k-fold per repeat r with seed ``seed+r``."""
    x = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    seed_key = F.concat(F.col("repeat").cast("string"), F.lit(":"), F.col(key).cast("string"))
    return x.withColumn("fold", hash_bucket(seed, seed_key, k).cast("int"))


def repeated_stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Per repeat, each label's rows are dealt to the folds in turn, in an order by a
    hash of repeat and key."""
    x = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    x = x.withColumn("__h", hash_u32(seed, F.concat(F.col("repeat").cast("string"), F.lit(":"), F.col(key).cast("string"))))
    r = global_rank(x, ["__h", key], ["repeat", label])
    return r.withColumn("fold", F.pmod(F.col("__rn") - 1, F.lit(k)).cast("int")).drop("__h", "__rn", "__cum", "__n", "__wt")


def shuffle_split(df: DataFrame, key: str, n_splits: int = 10, test_size: float = 0.2,
                  seed: int = 42) -> DataFrame:
    """Per split s, test if the seeded hash fraction < test_size."""
    x = df.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    seed_key = F.concat(F.col("split").cast("string"), F.lit(":"), F.col(key).cast("string"))
    return x.withColumn("role", F.when(hash_unit(seed, seed_key) < test_size, "test").otherwise("train"))


def stratified_shuffle_split(df: DataFrame, key: str, label: str, test_size: float = 0.2,
                             seed: int = 42) -> DataFrame:
    """Within each class the first round(test_size · n_class) rows in
    seeded-hash order are test."""
    x = df.withColumn("__h", hash_u32(seed, key))
    r = global_rank(x, ["__h", key], [label])
    return r.withColumn("role", F.when(F.col("__rn") <= F.round(F.col("__n") * test_size), "test")
                        .otherwise("train")).drop("__h", "__rn", "__cum", "__n", "__wt")


def stratified_group_kfold(df: DataFrame, group: str, label: str, k: int = 5) -> DataFrame:
    """H09 (approximation, stated): each group takes its dominant class; within
    a dominant class groups are dealt by size in a serpentine."""
    gc = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("__c"))
    dom = gc.groupBy(group).agg(F.max_by(F.col(label), F.struct("__c", F.col(label))).alias("__dom"),
                                F.sum("__c").alias("__size")).withColumn("__neg", -F.col("__size"))
    r = global_rank(dom, ["__neg", group], ["__dom"])
    folds = r.select(group, _serpentine(F.col("__rn") - 1, k).alias("fold"))
    return df.join(folds, group)


def leave_one_out(df: DataFrame, key: str) -> DataFrame:
    """Every row is its own test fold."""
    return df.withColumn("fold", F.col(key))


def predefined_split(df: DataFrame, fold_col: str) -> DataFrame:
    """Fold as given; −1 means never in a test fold."""
    return df.withColumn("fold", F.col(fold_col).cast("int")).withColumn("in_test", F.col("fold") != -1)


def train_test(df: DataFrame, key: str, test_size: float = 0.2, val_size: float = 0.0,
               seed: int = 42, label: str | None = None) -> DataFrame:
    """Test / val / train by seeded hash fraction (val share of the whole
    = val_size, i.e. val/(1−test) of the remainder); with ``label`` the cut
    is made per class on hash ranks (stratified)."""
    if label is None:
        u = hash_unit(seed, key)
        role = F.when(u < test_size, "test").when(u < test_size + val_size, "val").otherwise("train")
        return df.withColumn("role", role)
    x = df.withColumn("__h", hash_u32(seed, key))
    r = global_rank(x, ["__h", key], [label])
    n = F.col("__n")
    role = (F.when(F.col("__rn") <= F.round(n * test_size), "test")
            .when(F.col("__rn") <= F.round(n * (test_size + val_size)), "val").otherwise("train"))
    return r.withColumn("role", role).drop("__h", "__rn", "__cum", "__n", "__wt")


def uncertainty_sample(df: DataFrame, key: str | Sequence[str], lower: str, upper: str,
                       n: int = 10) -> DataFrame:
    """The n widest prediction intervals (ties by key); a distributed
    top-n (TakeOrderedAndProject), no full sort."""
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn("width", F.col(upper) - F.col(lower)).orderBy(F.desc("width"), *keys).limit(n)


def expected_improvement(mean: F.Column, lower: F.Column, upper: F.Column, best: float) -> F.Column:
    """std = (u−l)/4, z = (m−best)/(std+1e-9), EI = (m−best)Φ(z) + std·φ(z)."""
    from ..functions.columns import normal_cdf, normal_pdf
    std = (upper - lower) / 4
    z = (mean - F.lit(best)) / (std + 1e-9)
    return (mean - F.lit(best)) * normal_cdf(z) + std * normal_pdf(z)


def latin_hypercube(ids: DataFrame, key: str, n_dims: int, bounds: Sequence[tuple[float, float]] | None = None,
                    seed: int = 42) -> DataFrame:
    """One point per id; per dimension the ids are permuted by a seeded
    hash and point = low + (high−low)·(stratum + u)/n.  Long form (id, dim, value)."""
    bounds = list(bounds or [(0.0, 1.0)] * n_dims)
    x = ids.select(key).withColumn("dim", F.explode(F.sequence(F.lit(0), F.lit(n_dims - 1))))
    dk = F.concat(F.col("dim").cast("string"), F.lit(":"), F.col(key).cast("string"))
    x = x.withColumn("__h", hash_u32(seed, dk))
    r = global_rank(x, ["__h", key], ["dim"])
    lo = F.element_at(F.array(*[F.lit(float(b[0])) for b in bounds]), F.col("dim") + 1)
    hi = F.element_at(F.array(*[F.lit(float(b[1])) for b in bounds]), F.col("dim") + 1)
    u = hash_unit(f"{seed}u", dk)
    val = lo + (hi - lo) * ((F.col("__rn") - 1) + u) / F.col("__n")
    return r.select(key, "dim", (F.col("__rn") - 1).cast("int").alias("stratum"), val.alias("value"))


def lhs_coverage(points: DataFrame, bounds_width: float = 1.0) -> DataFrame:
    """Mean over dimensions of (max − min)/width."""
    return points.groupBy("dim").agg(((F.max("value") - F.min("value")) / bounds_width).alias("r")).agg(
        F.avg("r").alias("coverage"))


# ---------------------------------------------------------------- H14
def diversity_sample(df: DataFrame, key: str, vec_col: str, n: int, seed: int = 42) -> DataFrame:
    """H14 diversity: k-means with n clusters on the pool; the row nearest
    each centre (ties: smaller key)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector, vector_to_array
    x = df.select(key, array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    m = KMeans(k=n, seed=seed).fit(x)
    cents = m.clusterCenters()
    centre = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in cents])
    p = m.transform(x).withColumn("c", F.element_at(centre, F.col("prediction") + 1)).withColumn(
        "v", vector_to_array("features"))
    d = F.sqrt(F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, t: s + t))
    p = p.withColumn("dist", d)
    best = p.groupBy("prediction").agg(F.min_by(F.col(key), F.struct(F.round("dist", 9), F.col(key))).alias(key))
    return best.select(key, F.col("prediction").alias("cluster"))


def hybrid_sample(df: DataFrame, key: str, vec_col: str, lower: str, upper: str, n: int, seed: int = 42) -> DataFrame:
    """H14 hybrid: n//2 by uncertainty (widest interval), the rest by
    diversity on the pool without them (``left_anti``)."""
    n_unc = n // 2
    unc = uncertainty_sample(df, key, lower, upper, n_unc).select(key, F.lit("uncertainty").alias("source"))
    rest = df.join(unc.select(key), key, "left_anti")
    div = diversity_sample(rest, key, vec_col, n - n_unc, seed).select(key, F.lit("diversity").alias("source"))
    return unc.unionByName(div)
