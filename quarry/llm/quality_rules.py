"""Operator 8: robust multivariate outliers among text statistics, in DataFrame
functions only.

Base rules count words, symbols, repeated lines and repeated 5-word windows.
Per language and source the minimum covariance determinant (MCD) estimate of
transformed statistics is found by concentration steps until they rest: the three quarters of
the rows with the least Mahalanobis distance give the next mean and covariance.
All sums are grouped aggregates; the quarter is cut on a histogram of distances,
so that no group is gathered or sorted.  A last step reweights with the rows
inside the 97.5 % ellipsoid.  Rows outside the
ellipsoid that RATE of normal rows leave are rejected; symbols, repeated lines and word
length can do so alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
FEATURES = ("f1", "f2", "f3", "f4")
#: Least spread of each statistic, about what counting makes of it in texts of some
#: hundred words: one symbol, repeated line or repeated passage more or less, a tenth of a
#: word length.  The base rule leaves repeated words so little room that they
#: reject a row together with other statistics only.
FLOOR = (0.25, 0.30, 0.30, 0.10)
#: Rows of a (language, source) group that has an estimate of its own; rows of
#: smaller groups share one.
OWN_GROUP = 60
SHARE = 0.75
#: Change of an estimate at which concentration has come to rest, and steps at most.
REST, STEPS = 1e-3, 30
#: Share of normal rows that are rejected: it sets the squared distance beyond which
#: a row goes.
RATE = 5e-6


def _chi2(x: float, k: int) -> float:
    """Distribution function of chi-square with an even number k of degrees."""
    term, total = 1.0, 1.0
    for i in range(1, k // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def _quantile(p: float, k: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2(mid, k) < p else (low, mid)
    return low


def _consistent(share: float) -> float:
    """What a covariance of the inner ``share`` of normal rows lacks."""
    return share / _chi2(_quantile(share, len(FEATURES)), len(FEATURES) + 2)


def base_statistics(docs: DataFrame, text: Column, **extra: Column) -> DataFrame:
    """``extra`` columns, n_words, word_chars, n_symbols, n_lines, n_dup_lines
    and n_repeat_words of every whole text.  Windows and lines are compared by
    64-bit hashes and as strings, inside a row: no shuffle."""
    t = F.coalesce(text, F.lit(""))
    d = docs.select(*[c.alias(k) for k, c in extra.items()], t.alias("_t"))
    d = d.withColumn("_h", F.transform(F.filter(F.split("_t", SPACE), lambda x: x != ""), lambda x: F.xxhash64(x)))
    d = d.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.select(*extra, F.size("_h").cast("long").alias("n_words"),
                 F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
                 (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 F.size("_l").cast("long").alias("n_lines"),
                 (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
                 F.when(F.size("_h") >= 5, F.expr(
                     "transform(slice(_h, 1, size(_h) - 4), (x, i) -> "
                     "xxhash64(x, _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4]))")).alias("_w"))
    # Windows that occur twice: neighbours in sorted order; then the words that
    # their places cover.
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), F.expr(
        "sort_array(transform(_w, (x, i) -> struct(x as h, i as p)))"))).drop("_w")
    d = d.withColumn("_p", F.expr(
        "sort_array(transform(filter(_s, (e, i) -> coalesce(e.h = get(_s, i - 1).h, false) "
        "or coalesce(e.h = get(_s, i + 1).h, false)), e -> e.p))")).drop("_s")
    return d.withColumn("n_repeat_words", F.coalesce(F.expr(
        "aggregate(transform(_p, (p, i) -> least(5, coalesce(get(_p, i + 1) - p, 5))), 0L, (a, x) -> a + x)"),
        F.lit(0).cast("long"))).drop("_p")


def _features(d: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return (d.withColumn("f1", F.log1p(10 * F.col("n_symbols") / n))
            .withColumn("f2", F.log1p(10 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))))
            .withColumn("f3", F.log1p(10 * F.col("n_repeat_words") / n))
            # The mean word length of short texts is drawn to five characters.
            .withColumn("f4", F.log((F.col("word_chars") + 250) / (F.col("n_words") + 50))))


def _below(rows: DataFrame, value: Column, scale: float, share: float, name: str) -> DataFrame:
    """Per group g the upper end of the histogram bin in which ``share`` of the
    rows are reached; bins are 1 / ``scale`` wide."""
    bins = rows.select("g", F.floor(value * scale).alias("b")).groupBy("g", "b").agg(F.count("*").alias("k"))
    w = Window.partitionBy("g")
    run = bins.select("g", "b", F.sum("k").over(w.orderBy("b")).alias("k"), F.sum("k").over(w).alias("n"))
    return run.where(F.col("k") >= share * F.col("n")).groupBy("g").agg(((F.min("b") + 1) / scale).alias(name))


def _distance(d: DataFrame) -> Column:
    """Squared Mahalanobis distance by forward substitution in the Cholesky
    factor (columns l11 .. l44) about the mean (m1 .. m4)."""
    p, total, ys = len(FEATURES), None, []
    for i in range(1, p + 1):
        y = F.col(f"f{i}") - F.col(f"m{i}")
        for j in range(1, i):
            y = y - F.col(f"l{i}{j}") * ys[j - 1]
        ys.append(y / F.col(f"l{i}{i}"))
        total = ys[-1] * ys[-1] if total is None else total + ys[-1] * ys[-1]
    return total


def _moments(rows: DataFrame, factor: float) -> DataFrame:
    """Per group the mean and the Cholesky factor of factor * covariance, with
    FLOOR squared added on the diagonal."""
    p = len(FEATURES)
    out = rows.groupBy("g").agg(
        *[F.avg(f"f{i}").alias(f"m{i}") for i in range(1, p + 1)],
        *[F.covar_pop(f"f{i}", f"f{j}").alias(f"c{i}{j}") for i in range(1, p + 1) for j in range(1, i + 1)])
    for i in range(1, p + 1):
        for j in range(1, i + 1):
            v = F.col(f"c{i}{j}") * factor
            for k in range(1, j):
                v = v - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            if i == j:
                out = out.withColumn(f"l{i}{i}", F.sqrt(F.greatest(v, F.lit(0.0)) + FLOOR[i - 1] ** 2))
            else:
                out = out.withColumn(f"l{i}{j}", v / F.col(f"l{j}{j}"))
    return out.select("g", *[f"m{i}" for i in range(1, p + 1)],
                      *[f"l{i}{j}" for i in range(1, p + 1) for j in range(1, i + 1)])


def estimates(rows: DataFrame) -> DataFrame:
    """Reweighted MCD estimate of each group g of ``rows`` (g, f1 .. f4)."""
    p = len(FEATURES)
    start = None
    for i in range(1, p + 1):
        mid = _below(rows, F.col(f"f{i}"), 256, 0.5, f"m{i}")
        start = mid if start is None else start.join(mid, "g")
    start = start.select("g", *[f"m{i}" for i in range(1, p + 1)],
                         *[F.lit(FLOOR[i - 1] if i == j else 0.0).alias(f"l{i}{j}")
                           for i in range(1, p + 1) for j in range(1, i + 1)])
    now = materialize(start, "mcd")
    for _ in range(STEPS):
        d = rows.join(now, "g").select("g", *FEATURES, _distance(rows).alias("d"))
        cut = _below(d, F.log1p("d"), 64, SHARE, "cut")
        d = d.join(cut, "g").where(F.floor(F.log1p("d") * 64) / 64 < F.col("cut"))
        new = materialize(_moments(d, _consistent(SHARE)), "mcd")
        names = [c for c in now.columns if c != "g"]
        moved = new.join(now.toDF("g", *[f"{c}_" for c in names]), "g").agg(
            F.max(F.greatest(*[F.abs(F.col(c) - F.col(f"{c}_")) for c in names]))).first()[0]
        now = new
        if moved is None or moved < REST:
            break
    d = rows.join(now, "g").select("g", *FEATURES, _distance(rows).alias("d"))
    now = materialize(_moments(d.where(F.col("d") <= _quantile(0.975, p)), _consistent(0.975)), "mcd")
    return now


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    key = [F.col(c) for c in (id_col, text_col, lang_col, source_col)]
    d = base_statistics(docs, F.col(text_col), __k1=F.xxhash64(*key), __k2=F.xxhash64(F.lit(7), *key[::-1]), id=F.col(id_col),
                        lang=F.coalesce(F.col(lang_col).cast("string"), F.lit("")),
                        source=F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    d = materialize(_features(d.withColumn("base_failed", failed)), "statistics")
    sizes = d.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("k"))
    d = d.join(sizes, ["lang", "source"], "left").withColumn(
        "g", F.when(F.col("k") >= OWN_GROUP, F.to_json(F.struct("lang", "source"))).otherwise("*"))
    d = materialize(d.drop("k"), "grouped")
    cutoff = _quantile(1 - RATE, len(FEATURES))
    fit = estimates(d.where("not base_failed").select("g", *FEATURES))
    d = d.join(fit, "g", "left")
    return d.withColumn("distance", _distance(d)).withColumn(
        "kept", ~F.col("base_failed") & (F.coalesce(F.col("distance"), F.lit(0.0)) <= cutoff))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                  source_col: str = "source") -> DataFrame:
    """Per document: ``id_col``, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, distance (squared Mahalanobis).

    A null or empty text has no words and fails the base rules.  Null languages
    and sources form groups like any value; groups of fewer than OWN_GROUP rows
    share an estimate.  Repeated rows each give a row; an empty table gives
    none; only the four named columns are read.  A very long text is held whole,
    with a hash for each of its words and windows."""
    d = _judged(docs, id_col, text_col, lang_col, source_col)
    return d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    "base_failed", "kept", "distance")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
              source_col: str = "source") -> DataFrame:
    """All columns of the documents that ``quality_rules`` keeps."""
    key = [F.col(c) for c in (id_col, text_col, lang_col, source_col)]
    good = _judged(docs, id_col, text_col, lang_col, source_col).where("kept").select("__k1", "__k2").distinct()
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       F.xxhash64(*key).alias("__k1"), F.xxhash64(F.lit(7), *key[::-1]).alias("__k2"))
    return wide.join(good, ["__k1", "__k2"], "left_semi").select("row.*")
