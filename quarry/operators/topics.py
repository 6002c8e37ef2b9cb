"""Online variational LDA over word counts (J08) whose topics stay on the executors.

The steps and settings are those of Spark ML's online optimizer: mini-batches drawn with
replacement, variational inference of each document, natural gradient steps of the topics and of
the documents' prior.  Spark's holds several topics × words matrices in the driver; here the topics
are never whole anywhere.  After any number of steps

    topics[word] = c · start[word] + d + f · found[word]

with numbers c, d and f; ``start`` is drawn from a hash of the word, and ``found`` has a row only for
words of the mini-batches so far."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import RegexTokenizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Shape of the gamma draws that topics and documents start from (of mean 1).
_SHAPE = 100.0
#: Documents that are inferred at once.
_DOCS = 500


def digamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(8):
        out -= 1 / (x + i)
    y = 1 / (x + 8) ** 2
    return out + np.log(x + 8) - 0.5 / (x + 8) - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y / 132))))


def trigamma(x: np.ndarray) -> np.ndarray:
    out = np.zeros_like(x)
    for i in range(8):
        out += 1 / (x + i) ** 2
    z = x + 8
    y = 1 / z ** 2
    return out + 1 / z + y / 2 + y / z * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y / 30)))


def expectation(x: np.ndarray) -> np.ndarray:
    """E[log θ] of Dirichlet parameters along the last axis."""
    return digamma(x) - digamma(x.sum(axis=-1, keepdims=True))


def _uniform(h: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in (0, 1) by hash and turn (splitmix64)."""
    z = h + np.uint64(0x9E3779B97F4A7C15 * (turn + 1) & 0xFFFFFFFFFFFFFFFF)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(float) / (1 << 53) + 2.0 ** -54


def gamma_draws(h: np.ndarray, k: int) -> np.ndarray:
    """k draws of Gamma(``_SHAPE``) / ``_SHAPE`` for each 64-bit hash (Marsaglia and Tsang)."""
    d = _SHAPE - 1 / 3
    h = h.astype(np.int64).view(np.uint64)
    out = np.zeros((len(h), k))
    for j in range(k):
        todo, turn = np.arange(len(h)), 0
        while len(todo):
            u, v, w = (_uniform(h[todo], 3 * (turn * k + j) + i) for i in range(3))
            x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
            y = (1 + x / math.sqrt(9 * d)) ** 3
            ok = (y > 0) & (np.log(w) < 0.5 * x * x + d - d * y + d * np.log(np.where(y > 0, y, 1)))
            out[todo[ok], j] = d * y[ok] / _SHAPE
            todo, turn = todo[~ok], turn + 1
    return out


def infer(beta: np.ndarray, counts: np.ndarray, ends: np.ndarray, gamma: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variational inference of documents: words ends[i] … ends[i + 1] − 1 (one at least) are those
    of the i-th, with exp E[log β] and counts; ``gamma`` is its start.  Returns γ and the words'
    statistics, count · exp E[log θ] · exp E[log β] / norm.  A document rests when γ changes by
    1e-3 or less in the mean."""
    gamma, theta = gamma.copy(), np.exp(expectation(gamma))
    doc = np.repeat(np.arange(len(gamma)), np.diff(ends))
    todo, moving = np.arange(len(gamma)), np.ones(len(gamma), bool)
    b, n, at, starts = beta, counts, doc, ends[:-1]
    while moving.any():
        norm = np.einsum("ij,ij->i", b, theta[todo][at]) + 1e-100
        new = theta[todo] * np.add.reduceat(b * (n / norm)[:, None], starts) + alpha
        change = np.abs(new - gamma[todo]).mean(axis=1)
        gamma[todo[moving]] = new[moving]
        theta[todo[moving]] = np.exp(expectation(new[moving]))
        moving &= change > 1e-3
        if 2 * moving.sum() < len(todo):
            keep, place = moving[at], np.cumsum(moving) - 1
            b, n, at = b[keep], n[keep], place[at[keep]]
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            todo, moving = todo[moving], moving[moving]
    norm = (beta * theta[doc]).sum(axis=1) + 1e-100
    return gamma, theta[doc] * beta * (counts / norm)[:, None]


def _drawn(share: float, seed: int) -> Column:
    """How often a row is drawn: Poisson(share)."""
    u, upto, p, out = F.rand(seed), 0.0, math.exp(-share), F.lit(0)
    for i in range(1, 12):
        upto += p
        p *= share / i
        out = out + (u >= upto).cast("int")
    return out


def lda_topics(df: DataFrame, text_col: str, k: int = 5, vocab: int | None = None, max_iter: int = 10,
               seed: int = 42, top_terms: int = 8, min_docs: int = 1, share: float = 0.05) -> DataFrame:
    """J08 LDA topics over word counts (online LDA, mini-batches of a ``share`` of the rows); all
    words unless ``vocab`` or ``min_docs`` ask for fewer, the most frequent ones."""
    spark = df.sparkSession
    tok = RegexTokenizer(inputCol="text", outputCol="w", pattern="[ \\t\\r\\n]+", toLowercase=True)
    texts = df.select(F.col(text_col).alias("text"))
    every = tok.transform(texts).select("w")
    fewer = vocab is not None or min_docs > 1
    if not fewer:
        words = every.select(F.explode("w").alias("w")).distinct()
    else:
        words = every.select(F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        often = every.select(F.explode(F.array_distinct("w")).alias("w")).groupBy("w").agg(F.count("*").alias("docs"))
        words = words.join(often.where(F.col("docs") >= min_docs), "w")
        words = (words if vocab is None else words.orderBy(F.desc("n"), "w").limit(vocab)).select("w")
    mark = F.xxhash64("w", F.lit(seed)).alias("h")
    words = cut_lineage(words)
    names = [f"s{j}" for j in range(k)]
    sums = ", ".join(f"{s} double" for s in names)

    def add(it):
        size, total = 0, np.zeros(k)
        for b in it:
            x = gamma_draws(b.column(0).to_numpy(zero_copy_only=False), k)
            size, total = size + len(x), total + x.sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": [size], **{s: [float(v)] for s, v in zip(names, total)}})

    row = words.select(mark).mapInArrow(add, f"n bigint, {sums}").agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in names]).first()
    size, start = row["n"] or 0, np.array([row[s] or 0.0 for s in names])
    if not size:
        raise ValueError("no words")
    corpus = df.count()
    alpha, eta = np.full(k, 1 / k), 1 / k
    c, d, f = 1.0, 0.0, 1.0
    found = spark.createDataFrame([], f"w string, {sums}")
    total, step = np.zeros(k), 0

    for turn in range(max_iter):
        drawn = texts.withColumn("many", _drawn(share, seed + 7919 * (turn + 1))).where("many > 0")
        drawn = tok.transform(drawn.select("text", F.explode(F.array_repeat(F.lit(0), F.col("many")))).drop("col"))
        # In one select the ids would be those of the words.
        drawn = drawn.select(F.monotonically_increasing_id().alias("doc"), "w")
        batch = drawn.select("doc", F.explode("w").alias("w")).groupBy("doc", "w").agg(F.count("*").alias("n"))
        if fewer:
            batch = batch.join(words, "w", "left_semi")
        batch = batch.join(found, "w", "left").select("doc", "w", "n", mark, *names)
        docs = batch.groupBy("doc").agg(F.collect_list(F.struct("w", "n", "h", *names)).alias("s"))
        norm = digamma(c * start + d * size + f * total)

        def learn(it, c=c, d=d, f=f, norm=norm, alpha=alpha, turn=turn):
            for b in (x.slice(i, _DOCS) for x in it for i in range(0, x.num_rows, _DOCS)):
                s = b.column("s")
                flat = s.flatten()
                if not len(flat):
                    continue
                ends = np.append(0, np.cumsum(s.value_lengths().to_numpy(zero_copy_only=False)))
                had = np.column_stack([flat.field(x).fill_null(0.0).to_numpy(zero_copy_only=False) for x in names])
                topics = c * gamma_draws(flat.field("h").to_numpy(zero_copy_only=False), k) + d + f * had
                first = gamma_draws((b.column("doc").to_numpy(zero_copy_only=False) + 1) * 1_000_003 + turn, k)
                gamma, stats = infer(np.exp(digamma(topics) - norm), flat.field("n").to_numpy(zero_copy_only=False).astype(float), ends, first, alpha)
                yield pa.RecordBatch.from_arrays([flat.field("w"), *[pa.array(np.ascontiguousarray(x)) for x in stats.T], pa.nulls(len(stats), pa.int64())],
                                                 ["w", *names, "docs"])
                # The sums of E[log θ] go along, without a word.
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), *[pa.array([float(v)]) for v in expectation(gamma).sum(axis=0)],
                                                  pa.array([len(gamma)], pa.int64())], ["w", *names, "docs"])

        got = cut_lineage(docs.mapInArrow(learn, f"w string, {sums}, docs bigint").groupBy("w").agg(
            *[F.sum(s).alias(s) for s in names], F.sum("docs").alias("docs")))
        seen = got.where("w is null").first()
        if seen is None:
            continue
        step += 1
        rho = (1024 + step) ** -0.51
        c, d, f = (1 - rho) * c, (1 - rho) * d + rho * eta, (1 - rho) * f
        scale = rho * corpus / math.ceil(share * corpus) / f
        new = got.where("w is not null").select("w", *[(F.col(s) * F.lit(scale)).alias(s) for s in names])
        found = cut_lineage(found.unionByName(new).groupBy("w").agg(*[F.sum(s).alias(s) for s in names]))
        row = found.agg(*[F.sum(s).alias(s) for s in names]).first()
        total = np.array([row[s] or 0.0 for s in names])
        # A Newton step of the documents' prior.
        many = float(seen["docs"])
        slope = many * (np.array([seen[s] for s in names]) / many - expectation(alpha))
        q = -many * trigamma(alpha)
        shift = (slope / q).sum() / (1 / (many * trigamma(np.array([alpha.sum()]))[0]) + (1 / q).sum())
        moved = alpha - rho * (slope - shift) / q
        if (moved > 0).all():
            alpha = moved

    whole = c * start + d * size + f * total

    def best(it):
        """The ``top_terms`` words of each topic in a task."""
        held = [[] for _ in names]
        for b in it:
            had = np.column_stack([b.column(s).fill_null(0.0).to_numpy(zero_copy_only=False) for s in names])
            weight = (c * gamma_draws(b.column("h").to_numpy(zero_copy_only=False), k) + d + f * had) / whole
            for j in range(k):
                w = weight[:, j]
                # Words of the least weight that counts all stay: ties go by word.
                at = np.flatnonzero(w >= np.partition(w, -top_terms)[-top_terms]) if len(w) > top_terms else np.arange(len(w))
                mine = zip((-w[at]).tolist(), b.column("w").take(pa.array(at)).to_pylist())
                held[j] = sorted([*held[j], *mine])[:top_terms]
        rows = [(j, w, -v) for j, x in enumerate(held) for v, w in x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.string(), pa.float64()))], ["topic", "w", "weight"])

    rows = words.join(found, "w", "left").select("w", mark, *names).mapInArrow(best, "topic int, w string, weight double").collect()
    tops = [sorted((-r["weight"], r["w"]) for r in rows if r["topic"] == j)[:top_terms] for j in range(k)]
    return spark.createDataFrame([(j, [w for _, w in x], [-v for v, _ in x]) for j, x in enumerate(tops)],
                                 "topic int, terms array<string>, termWeights array<double>")
