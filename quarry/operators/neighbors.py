"""Exact nearest-neighbour and radius joins over numeric vectors.

Equal vectors are one point.  Points are dealt to cells around pivots (points of
the searched side themselves, so that dense regions get many small cells); a
point keeps its distance to its pivot.  By the triangle inequality no point of a
cell whose pivot is p and whose points lie between ``lo`` and ``hi`` from p is
nearer to q than max(d(q, p) - hi, lo - d(q, p)); nor is one nearer than the plane
halfway between p and q's own pivot.  A query first searches its own
cell, which bounds its k-th distance, and then just the cells that this bound
does not exclude.  Cells are cut into blocks of bounded size; a task holds one
block of each side.  Vectors of more than WIDE features leave few cells out, so
their cells and blocks are larger: a row is then sent to fewer of them.

Euclidean distances are matrix products with a bound on their error; whatever that
bound leaves undecided is computed from the differences.

Only pivots and per-cell counts, at most PIVOTS rows, pass through the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Points per pivot that are aimed at, pivots at most, points of a block at most.
CELL_POINTS, PIVOTS, BLOCK_POINTS = 512, 4096, 2048
#: Features from which on cells and blocks are larger, numbers of such a block at most,
#: and parts of a table they are at least cut into.
WIDE, WIDE_BLOCK, WIDE_PARTS = 16, 2_097_152, 8
#: Pairs of null patterns that are joined one by one; beyond, all points are one cell.
PATTERN_PAIRS = 64
#: Cells of a distance table that are held at once.
_TABLE = 4_000_000


# ---------------------------------------------------------------- distances


def distances(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """All distances; features that are NaN on a side do not count, and the rest is
    scaled up to all features (infinite where none is left)."""
    out = np.empty((len(q), len(d)))
    step = max(1, _TABLE // max(1, d.shape[0] * d.shape[1]))
    holes = bool(np.isnan(q).any() or np.isnan(d).any())
    for s in range(0, len(q), step):
        diff = q[s:s + step, None, :] - d[None, :, :]
        if holes:
            left = diff.shape[2] - np.isnan(diff).sum(axis=2)
            diff = np.nan_to_num(diff)
        if metric == "euclidean":
            one = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
        else:
            one = np.abs(diff).sum(-1) if metric == "manhattan" else np.abs(diff).max(-1)
        if holes:
            one = np.where(left > 0, one * _rescaled(metric, diff.shape[2] / np.maximum(left, 1)), np.inf)
        out[s:s + step] = one
    return out


def _squares(q: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Squared euclidean distances by one matrix product, and the greatest error of a
    row's; None where a value is missing or too great for it."""
    mid = d.mean(axis=0)
    a, b = q - mid, d - mid
    na, nb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    most = na.max() + nb.max()
    if not most < 1e300:
        return None
    sq = a @ b.T
    sq *= -2.0
    sq += na[:, None]
    sq += nb[None, :]
    return sq, 8 * (q.shape[1] + 8) * np.finfo(float).eps * (na + nb.max())


def _each(q: np.ndarray, d: np.ndarray, ii: np.ndarray, jj: np.ndarray) -> np.ndarray:
    """Euclidean distances of single pairs of rows, from their differences."""
    out = np.empty(len(ii))
    step = max(1, _TABLE // q.shape[1])
    for s in range(0, len(ii), step):
        diff = q[ii[s:s + step]] - d[jj[s:s + step]]
        out[s:s + step] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
    return out


def _within_eps(q: np.ndarray, d: np.ndarray, eps: float) -> np.ndarray:
    """Which pairs have a euclidean distance, rounded to 9 digits, of at most ``eps``."""
    found = _squares(q, d) if len(q) and len(d) else None
    if found is None:
        return _score(q, d, "euclidean") <= eps
    sq, err = found
    low, high = max(0.0, eps - 1e-9), max(0.0, eps + 1e-9)
    close = sq <= (low * low * (1 - 1e-12) - err)[:, None]
    ii, jj = np.nonzero(~close & (sq <= (high * high * (1 + 1e-12) + err)[:, None]))
    close[ii, jj] = np.round(_each(q, d, ii, jj), 9) <= eps
    return close


def _tiles(q: np.ndarray, d: np.ndarray):
    """Slices of q whose table of distances to d is held at once."""
    step = max(1, _TABLE // max(1, len(d)))
    return [slice(s, s + step) for s in range(0, len(q), step)]


def _rescaled(metric: str, up):
    """What a distance over a share 1 / up of the features is multiplied by."""
    return np.sqrt(up) if metric == "euclidean" else up if metric == "manhattan" else np.ones_like(up)


def _unit(v: np.ndarray, query: bool) -> np.ndarray:
    """Unit vectors, whose euclidean distance orders as the cosine does; a zero
    vector gets an axis of its own, at cosine 0 to all of the other side."""
    norm = np.linalg.norm(v, axis=1)
    out = np.zeros((len(v), v.shape[1] + 2))
    some = norm > 0
    out[some, :-2] = v[some] / norm[some, None]
    out[~some, -1 if query else -2] = 1.0
    return out


def _score(q: np.ndarray, d: np.ndarray, metric: str) -> np.ndarray:
    """What ranks, smaller first, rounded so that ranks do not depend on the engine."""
    return -np.round(q @ d.T, 9) if metric == "cosine" else np.round(distances(q, d, metric), 9)


def _reach(score: np.ndarray, metric: str) -> np.ndarray:
    """Distance in the cells' space that a rounded score allows at most."""
    if metric == "cosine":
        return np.sqrt(np.maximum(0.0, 2.0 + 2.0 * (score + 4e-9))) + 1e-7
    return score * (1 + 1e-9) + 1e-8


def _vectors(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


# ---------------------------------------------------------------- points and cells


def vectors(df: DataFrame, id_col: str, vec_col: str, zero: bool = False) -> DataFrame:
    """(id, v): double vectors with null for NaN (0 for both if ``zero``); rows
    without an id or a vector are left out."""
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(0.0))
                    if zero else F.nanvl(x, F.lit(None).cast("double")))
    return df.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0))


def points(x: DataFrame, keep: int) -> DataFrame:
    """(rep, v, n, ids): each different vector once, its smallest id, its number of
    rows, and its ``keep`` smallest ids."""
    w = Window.partitionBy("v").orderBy("id")
    first = (x.withColumn("r", F.row_number().over(w)).where(F.col("r") <= keep)
             .groupBy("v").agg(F.min("id").alias("rep"), F.array_sort(F.collect_list("id")).alias("ids")))
    return first.join(x.groupBy("v").agg(F.count("*").alias("n")), "v").select("rep", "v", "n", "ids")


class Space:
    """Where distances are taken: features, scale, pivots, and what the cells hold."""

    def __init__(self, metric: str, scale: float, keep: list[int] | None):
        self.metric, self.scale, self.keep, self.pivots = metric, scale, keep, None
        self.n, self.lo, self.hi = np.zeros(1, np.int64), np.zeros(1), np.zeros(1)

    def embed(self, v: np.ndarray, query: bool) -> np.ndarray:
        v = v if self.keep is None else v[:, self.keep]
        return _unit(v, query) if self.metric == "cosine" else v * self.scale

    def far(self, v: np.ndarray) -> np.ndarray:
        """Distances to the pivots, within a billionth of each."""
        found = _squares(v, self.pivots) if self.metric in ("euclidean", "cosine") and len(v) else None
        if found is None:
            return distances(v, self.pivots, "euclidean" if self.metric == "cosine" else self.metric)
        sq, err = found
        ii, jj = np.nonzero(sq <= (err * 1e9)[:, None])
        far = np.sqrt(np.maximum(sq, 0.0))
        far[ii, jj] = _each(v, self.pivots, ii, jj)
        return far

    def bounds(self, v: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest distance to the points of each cell; ``own`` is the
        nearest pivot.  In euclidean space a cell lies beyond the plane halfway
        between its pivot and the own one, too."""
        far = self.far(v)
        slack = 2e-9
        least = np.maximum(np.maximum(far * (1 - slack) - self.hi * (1 + slack), self.lo * (1 - slack) - far * (1 + slack)), 0.0)
        if self.metric in ("euclidean", "cosine"):
            cells, place = np.unique(own, return_inverse=True)
            apart = self.far(self.pivots[cells])[place]
            near = far[np.arange(len(v)), own][:, None]
            plane = (far * far * (1 - 2 * slack) - near * near * (1 + 2 * slack)) / np.where(apart > 0, 2 * apart, np.inf)
            least = np.maximum(least, plane * (1 - 1e-9) - 1e-9)
        return least, (far + self.hi) * (1 + slack)


class Cells:
    """Pivots and the cells of the searched points (rep, v, ...) around them."""

    def __init__(self, pts: DataFrame, metric: str, scale: float = 1.0, keep: list[int] | None = None, split: bool = True):
        self.spark, self.space = pts.sparkSession, Space(metric, scale, keep)
        n, width = pts.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
        width = width if keep is None else len(keep)
        wide = max(BLOCK_POINTS, min(WIDE_BLOCK // width, math.ceil(n / WIDE_PARTS))) if width > WIDE else 0
        self.block = wide or BLOCK_POINTS
        pivots = min(PIVOTS, max(1, math.ceil(n / (wide or CELL_POINTS)))) if split else 1
        if pivots > 1:
            rows = pts.select("v").orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
            self.space.pivots = self.space.embed(np.array([r["v"] for r in rows], float), False)
        self.searched = cut_lineage(self.deal(pts, False))
        found = self.searched.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()
        n, lo, hi = np.zeros(pivots, np.int64), np.full(pivots, np.inf), np.full(pivots, -np.inf)
        for r in found:
            n[r["cell"]], lo[r["cell"]], hi[r["cell"]] = r["n"], r["lo"], r["hi"]
        self.space.n, self.space.lo, self.space.hi = n, lo, hi

    @property
    def pivots(self) -> np.ndarray | None:
        return self.space.pivots

    def deal(self, pts: DataFrame, query: bool) -> DataFrame:
        """Points with their vectors in the cells' space, nearest pivot and distance to it."""
        fields = [f for f in pts.schema.fields if f.name != "v"]
        names = [f.name for f in fields]
        space, pivots = self.space, self.pivots

        def run(it):
            for b in it:
                if not b.num_rows:
                    continue
                v = space.embed(_vectors(b.column(len(names))), query)
                cell, r = np.zeros(len(v), np.int32), np.zeros(len(v))
                step = max(1, _TABLE // (4 * len(pivots))) if pivots is not None else len(v)
                for s in range(0, len(v), step) if pivots is not None else ():
                    far = space.far(v[s:s + step])
                    cell[s:s + step] = far.argmin(axis=1)
                    r[s:s + step] = far.min(axis=1)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v.shape[1], pa.int32()), pa.array(v.ravel(), from_pandas=True))
                yield pa.RecordBatch.from_arrays([*b.columns[:len(names)], flat, pa.array(cell), pa.array(r)], [*names, "v", "cell", "r"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        return pts.select(*names, "v").mapInArrow(run, f"{schema}, v array<double>, cell int, r double")

    def others(self, queries: DataFrame, need: int | None, radius: float | None = None) -> tuple[DataFrame, DataFrame]:
        """Queries (with ``cell``, and ``top``: a score that k points reach, or null) once
        for each further cell that may hold a nearer point, or with ``radius``
        one within it; and the number of queries for each cell."""
        names = [c for c in queries.columns if c != "cell"]
        at = {c: i for i, c in enumerate(queries.columns)}
        space = self.space
        sizes, metric = space.n, space.metric

        def visits(b):
            v = _vectors(b.column(at["v"]))
            own = b.column(at["cell"]).to_numpy(zero_copy_only=False)
            top = None if radius is not None else b.column(at["top"]).to_numpy(zero_copy_only=False)
            step = max(1, _TABLE // (4 * len(sizes)))
            for s in range(0, len(v), step):
                least, most = space.bounds(v[s:s + step], own[s:s + step])
                if radius is not None:
                    reach = np.full(len(least), radius * (1 + 1e-9) + 1e-8)
                else:
                    # Cells by their farthest point, until they hold enough points.
                    order = np.argsort(most, axis=1)
                    enough = np.cumsum(sizes[order], axis=1) >= need
                    k = np.where(enough.any(axis=1), enough.argmax(axis=1), len(sizes) - 1)
                    row = np.arange(len(least))
                    held = np.where(enough.any(axis=1), most[row, order[row, k]], np.inf)
                    reach = np.fmin(_reach(top[s:s + step].astype(float), metric), held + 1e-8)
                go = least <= reach[:, None]
                go[np.arange(len(go)), own[s:s + step]] = False
                yield s, go

        def run(it):
            for b in it:
                for s, go in visits(b) if b.num_rows else ():
                    row, cell = np.nonzero(go)
                    for k in range(0, len(row), BLOCK_POINTS):
                        t = b.take(pa.array(s + row[k:k + BLOCK_POINTS]))
                        yield pa.RecordBatch.from_arrays([*(t.column(at[c]) for c in names), pa.array(cell[k:k + BLOCK_POINTS].astype(np.int32))],
                                                         [*names, "cell"])

        def count(it):
            total = np.zeros(len(sizes), np.int64)
            for b in it:
                for _, go in visits(b) if b.num_rows else ():
                    total += go.sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sizes), dtype=np.int32)), pa.array(total)], ["cell", "n"])

        kinds = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in names)
        return queries.mapInArrow(run, f"{kinds}, cell int"), queries.mapInArrow(count, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))

    def meet(self, queries: DataFrame, counts: DataFrame, kernel: Callable, schema: str, searched: DataFrame | None = None) -> DataFrame:
        """``kernel`` on each pair of blocks of a cell's queries and searched points."""
        searched = self.searched if searched is None else searched
        asked = {r["cell"]: r["n"] for r in counts.collect() if r["n"]}
        if not asked:
            return self.spark.createDataFrame([], schema)
        plan = F.broadcast(self.spark.createDataFrame(  # a row per cell: PIVOTS at most
            [(int(c), max(1, math.ceil(n / self.block)), max(1, math.ceil(int(self.space.n[c]) / self.block))) for c, n in asked.items()],
            "cell int, __a int, __b int"))

        def blocks(df: DataFrame, mine: str, theirs: str) -> DataFrame:
            deal = F.pmod(F.xxhash64("rep"), F.col(f"__{mine}")).cast("int")
            return (df.join(plan, "cell").withColumn(f"k{mine}", deal)
                    .withColumn(f"k{theirs}", F.explode(F.sequence(F.lit(0), F.col(f"__{theirs}") - 1))).drop("__a", "__b"))

        keys = ["cell", "ka", "kb"]
        return (blocks(queries, "a", "b").groupBy(*keys).cogroup(blocks(searched, "b", "a").groupBy(*keys))
                .applyInArrow(kernel, schema))


# ---------------------------------------------------------------- nearest neighbours


def _candidates(q: np.ndarray, d: np.ndarray, need: int, metric: str, top: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that hold the ``need`` best of each row of q, with their scores; those of a
    score above ``top`` may be left out."""
    found = _squares(q, d) if metric == "euclidean" and need < len(d) else None
    if found is None:
        score = _score(q, d, metric)
        cut = np.partition(score, need - 1, axis=1)[:, need - 1] if need < len(d) else np.full(len(q), np.inf)
        ii, jj = np.nonzero((score <= cut[:, None]) & np.isfinite(score))
        return ii, jj, score[ii, jj]
    sq, err = found
    cut = np.where(np.isnan(top), np.inf, top + 1e-9) * (1 + 1e-12)
    close = sq <= (cut * cut * (1 + 1e-12) + err)[:, None]
    if close.sum() > 16 * need * len(q):
        # At least need pairs lie within the cut, whatever the error; 1e-9 for the rounding.
        held = np.sqrt(np.maximum(np.partition(sq, need - 1, axis=1)[:, need - 1] + err, 0.0)) * (1 + 1e-12) + 1e-9
        close = sq <= (np.minimum(cut, held) ** 2 * (1 + 1e-12) + err)[:, None]
    ii, jj = np.nonzero(close)
    return ii, jj, np.round(_each(q, d, ii, jj), 9)


def _nearest_kernel(need: int, metric: str, bounded: bool, seen: Accumulator | None):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("rep")
        q, d = _vectors(left.column("v")), _vectors(right.column("v"))
        if not len(q) or not len(d):
            ii, jj, best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        else:
            if seen is not None:
                seen.add(len(q) * len(d))
            parts = []
            tops = left.column("top").to_numpy().astype(float) if bounded else np.full(len(q), np.nan)
            for t in _tiles(q, d):
                ii, jj, score = _candidates(q[t], d, need, metric, tops[t])
                kept = ~(score > tops[t][ii])
                ii, jj, score = ii[kept], jj[kept], score[kept]
                # Of ties at the cut the smallest ids: need of them are enough.
                order = np.lexsort((jj, score, ii))
                ii, jj, score = ii[order], jj[order], score[order]
                first = np.arange(len(ii)) - np.searchsorted(ii, ii) < need
                parts.append((ii[first] + t.start, jj[first], score[first]))
            ii, jj, best = (np.concatenate(x) for x in zip(*parts))
        return pa.table({"qrep": left.column("rep").take(pa.array(ii)), "drep": right.column("rep").take(pa.array(jj)),
                         "score": pa.array(best, pa.float64())})
    return run


def _nearest_points(q: DataFrame, d: DataFrame, need: int, metric: str, cells: Cells, seen) -> DataFrame:
    """(qrep, drep, score): at least the ``need`` best points of d for each point of q."""
    kinds = f"qrep {q.schema['rep'].dataType.simpleString()}, drep {d.schema['rep'].dataType.simpleString()}, score double"
    asked = cut_lineage(cells.deal(q, True))
    own = cells.meet(asked, asked.groupBy("cell").agg(F.count("*").alias("n")), _nearest_kernel(need, metric, False, seen), kinds)
    if cells.pivots is None:
        return own
    own = cut_lineage(own)
    w = Window.partitionBy("qrep").orderBy("score", "drep")
    top = (own.withColumn("k", F.row_number().over(w)).where(F.col("k") <= need).groupBy("qrep")
           .agg(F.when(F.count("*") == need, F.max("score")).alias("top")))
    bounded = cut_lineage(asked.join(top.withColumnRenamed("qrep", "rep"), "rep", "left"))
    more, counts = cells.others(bounded, need)
    return own.unionByName(cells.meet(more, counts, _nearest_kernel(need, metric, True, seen), kinds))


def _pattern(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.when(x.isNull(), "0").otherwise("1")), "")


def dense_topk(q: DataFrame, d: DataFrame, q_id: str, d_id: str, vec_col: str, k: int, metric: str = "euclidean",
               exclude_self: bool = False, seen: Accumulator | None = None) -> DataFrame:
    """Exact k nearest rows of ``d`` for every row of ``q``: ``qid, did, score,
    rank``.  ``score`` is the distance (euclidean, manhattan, chebyshev) or the
    cosine similarity, rounded to 9 digits; ties go to the smaller id.

    Ids may have any orderable type; rows without an id or a vector have no
    neighbours and are none.  A feature that is null or NaN on a side of a pair does
    not count, and the distance is scaled up by the share of the rest; rows
    without a common feature are no neighbours.  For the cosine it counts as 0.
    Repeated rows count each; empty tables give no rows.  ``seen`` adds up the
    distances between points that were computed."""
    if metric not in ("euclidean", "manhattan", "chebyshev", "cosine"):
        raise ValueError(metric)
    need = k + 1 if exclude_self else k
    zero = metric == "cosine"
    qv, dv = vectors(q, q_id, vec_col, zero), vectors(d, d_id, vec_col, zero)
    dp = cut_lineage(points(dv, need))
    qp = dp if q is d and q_id == d_id else cut_lineage(points(qv, 1))
    edges = None
    for part_q, part_d, cells in _pattern_pairs(qp, dp, metric):
        e = _nearest_points(part_q, part_d, need, metric, cells, seen)
        edges = e if edges is None else edges.unionByName(e)
    if edges is None:
        return q.sparkSession.createDataFrame([], _topk_schema(qv, dv))
    w = Window.partitionBy("qrep").orderBy("score", "drep")
    best = edges.withColumn("r", F.row_number().over(w)).where(F.col("r") <= need).drop("r")
    rows = best.join(dp.select(F.col("rep").alias("drep"), "ids"), "drep").select("qrep", "score", F.explode("ids").alias("did"))
    # Of one point's rows the need smallest ids come first among all that tie.
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("qrep").orderBy("score", "did"))).where(F.col("r") <= need).drop("r")
    named = qv.join(qp.select(F.col("rep").alias("qrep"), "v"), _same("v", qv, qp)).select(qv["id"].alias("qid"), "qrep")
    out = named.join(rows, "qrep").select("qid", "did", "score")
    if exclude_self:
        out = out.where(F.col("qid") != F.col("did"))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("score", "did"))).where(F.col("rank") <= k)
    return out.withColumn("score", -F.col("score") + 0.0) if metric == "cosine" else out


def _same(name: str, a: DataFrame, b: DataFrame) -> Column:
    return a[name].eqNullSafe(b[name])


def _topk_schema(qv: DataFrame, dv: DataFrame) -> str:
    return (f"qid {qv.schema['id'].dataType.simpleString()}, did {dv.schema['id'].dataType.simpleString()}, "
            "score double, rank int")


def _pattern_pairs(qp: DataFrame, dp: DataFrame, metric: str):
    """(queries, searched points, their cells) for each pair of null patterns that have
    a feature in common: on common features the distance is a metric again."""
    def patterns(df):
        return [r["p"] for r in df.select(_pattern(F.col("v")).alias("p")).distinct().limit(PATTERN_PAIRS + 1).collect()]

    mine, theirs = patterns(qp), patterns(dp)
    if len(mine) * len(theirs) > PATTERN_PAIRS:
        yield qp, dp, Cells(dp, metric, split=False)
        return
    for a in mine:
        for b in theirs:
            common = [i for i, (x, y) in enumerate(zip(a, b)) if x == y == "1"]
            if not common:
                continue
            whole = len(common) == len(a) == len(b)
            up = len(a) / len(common)
            cells = Cells(dp.where(_pattern(F.col("v")) == b).drop("n", "ids"), metric,
                          float(_rescaled(metric, np.float64(up))), None if whole else common)
            yield qp.where(_pattern(F.col("v")) == a).drop("n", "ids"), dp, cells


# ---------------------------------------------------------------- radius


def dense_radius(q: DataFrame, d: DataFrame, q_id: str, d_id: str, vec_col: str, eps: float, exclude_self: bool = False) -> DataFrame:
    """All pairs ``qid, did, score`` with a euclidean distance of at most ``eps``
    (rounded to 9 digits).  Rows with a null feature, id or vector have no pairs."""
    qv, dv = _whole(vectors(q, q_id, vec_col)), _whole(vectors(d, d_id, vec_col))
    dp, qp = cut_lineage(points(dv, 1)), cut_lineage(points(qv, 1))
    cells = Cells(dp.select("rep", "v"), "euclidean")
    kinds = f"qrep {qp.schema['rep'].dataType.simpleString()}, drep {dp.schema['rep'].dataType.simpleString()}, score double"

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _vectors(left.column("v")), _vectors(right.column("v"))
        held = [np.nonzero(_within_eps(a[t], b, eps)) for t in _tiles(a, b)] if len(b) else []
        ii = np.concatenate([np.empty(0, np.int64), *(i + t.start for (i, _), t in zip(held, _tiles(a, b)))])
        jj = np.concatenate([np.empty(0, np.int64), *(j for _, j in held)])
        return pa.table({"qrep": left.column("rep").take(pa.array(ii)), "drep": right.column("rep").take(pa.array(jj)),
                         "score": pa.array(np.round(_each(a, b, ii, jj), 9), pa.float64())})

    found = _within(cells, qp.select("rep", "v"), eps, kernel, kinds)
    named_q = qv.join(qp.select(F.col("rep").alias("qrep"), "v"), "v").select(F.col("id").alias("qid"), "qrep")
    named_d = dv.join(dp.select(F.col("rep").alias("drep"), "v"), "v").select(F.col("id").alias("did"), "drep")
    out = found.join(named_q, "qrep").join(named_d, "drep").select("qid", "did", "score")
    return out.where(F.col("qid") != F.col("did")) if exclude_self else out


def _whole(x: DataFrame) -> DataFrame:
    return x.where(F.forall("v", lambda e: e.isNotNull()))


def _within(cells: Cells, queries: DataFrame, eps: float, kernel: Callable, schema: str, searched: DataFrame | None = None) -> DataFrame:
    """``kernel`` on all blocks that may hold points within ``eps``."""
    asked = cut_lineage(cells.deal(queries, True))
    out = cells.meet(asked, asked.groupBy("cell").agg(F.count("*").alias("n")), kernel, schema, searched)
    if cells.pivots is None:
        return out
    more, counts = cells.others(asked, None, eps)
    return out.unionByName(cells.meet(more, counts, kernel, schema, searched))


def dbscan(df: DataFrame, id_col: str, vec_col: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``id_col, cluster``.  A row with at least ``min_samples`` rows within
    ``eps`` (itself included) is core; core rows within ``eps`` are of one cluster,
    named by its smallest core id; other rows take the smallest cluster of the core rows
    within ``eps``, else null.  Rows with a null feature are in no cluster.

    No pair leaves its task: blocks report numbers of neighbours, spanning stars of
    their core rows, and the least cluster near a row."""
    x = vectors(df, id_col, vec_col)
    pts = cut_lineage(points(_whole(x), 1).select("rep", "v", "n"))
    cells = Cells(pts, "euclidean")
    kind = pts.schema["rep"].dataType.simpleString()
    near = _near_kernel(eps)
    count = _within(cells, pts.select("rep", "v"), eps, near("n", "sum"), f"rep {kind}, x bigint").groupBy("rep").agg(F.sum("x").alias("x"))
    core = cut_lineage(count.where(F.col("x") >= min_samples).select("rep"))
    core_cells = cells.searched.join(core, "rep", "left_semi")
    stars = _within(cells, pts.join(core, "rep", "left_semi").select("rep", "v"), eps, _star_kernel(eps), f"u {kind}, v {kind}", core_cells)
    label = smallest_of_component(core, stars)
    named = cut_lineage(core_cells.join(label, "rep"))
    border = _within(cells, pts.join(core, "rep", "left_anti").select("rep", "v"), eps, near("label", "min"), f"rep {kind}, x {kind}", named)
    border = border.groupBy("rep").agg(F.min("x").alias("label"))
    done = label.select("rep", "label").unionByName(border)
    named = pts.select("rep", "v").join(done, "rep")
    return x.join(named, _same("v", x, named), "left").select(F.col("id").alias(id_col), F.col("label").alias("cluster"))


def _near_kernel(eps: float):
    """Kernels that sum up, or take the least of, a column of the points within eps."""
    def of(column: str, how: str):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by(column)  # the first point within eps has the least
            a, b = _vectors(left.column("v")), _vectors(right.column("v"))
            some, sums, first = np.zeros(len(a), bool), [], [np.empty(0, np.int64)]
            weight = right.column(column).to_numpy().astype(float) if how == "sum" else None
            for t in _tiles(a, b) if len(b) else ():
                close = _within_eps(a[t], b, eps)
                some[t] = any_ = close.any(axis=1)
                if how == "sum":
                    sums.append(close[any_].astype(float) @ weight)
                elif any_.any():
                    first.append(close[any_].argmax(axis=1))
            if how == "sum":
                x = pa.array(np.concatenate([np.empty(0), *sums]).astype(np.int64))
            else:
                x = right.column(column).take(pa.array(np.concatenate(first)))
            return pa.table({"rep": left.column("rep").filter(pa.array(some)), "x": x})
        return run
    return of


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest of each number's component of the edges u, v."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _star_kernel(eps: float):
    """(u, v): each point of two blocks with the first one of its component in the blocks."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = _vectors(left.column("v")), _vectors(right.column("v"))
        u, v = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        step = math.isqrt(_TABLE)
        for s in range(0, len(a), step):
            for r in range(0, len(b), step):
                close = _within_eps(a[s:s + step], b[r:r + step], eps)
                rows, cols = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
                if not len(rows):
                    continue
                close = close[np.ix_(rows, cols)]
                label = np.arange(len(rows))
                while True:  # least row of the tile that each one reaches
                    over = np.where(close, label[:, None], len(rows)).min(axis=0)
                    new = np.minimum(label, np.where(close, over[None, :], len(rows)).min(axis=1))
                    if (new == label).all():
                        break
                    label = new
                u += [s + rows, len(a) + r + cols]
                v += [s + rows[label], s + rows[over]]
        root = _roots(len(a) + len(b), np.concatenate(u), np.concatenate(v))
        away = np.flatnonzero(root != np.arange(len(root)))
        names = pa.chunked_array([*left.column("rep").chunks, *right.column("rep").chunks], left.column("rep").type)
        return pa.table({"u": names.take(pa.array(away)), "v": names.take(pa.array(root[away]))})
    return run


def smallest_of_component(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rep, label): the smallest node of each node's component of ``edges`` (u, v).

    Labels spread to neighbours and jump to their label's label until none
    changes; each round is a checkpoint."""
    both = cut_lineage(edges.where("u <> v").select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut_lineage(nodes.select("rep", F.col("rep").alias("label")))
    while True:
        near = both.join(label.toDF("v", "l"), "v").groupBy(F.col("u").alias("rep")).agg(F.min("l").alias("l"))
        spread = label.join(near, "rep", "left").select("rep", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = label.select(F.col("rep").alias("label"), F.col("label").alias("far"))
        new = cut_lineage(spread.join(jump, "label").select("rep", "old", F.least("label", "far").alias("label")))
        label = new.select("rep", "label")
        if new.where("label <> old").isEmpty():
            return label
