"""Operator 12: ranked lexical search by presence-mask grouping.

The items are the query set, taken in blocks of bounded text.  Per block, one pass
over the documents counts the block's terms in each of them (a written table of
term numbers and counts); document frequencies and lengths are summed up over all
of it.  A second pass scores: the terms' bitmaps over a batch of documents give
each document the mask of the item's terms that it has; documents are grouped by
mask, the mask's greatest possible score is the sum of its terms' greatest
contributions in the batch, and masks are evaluated by descending greatest score
until it falls under the k-th best score that the task has found.  A task
passes on k documents an item, which two windows, by item and slice of tasks and
by item, rank.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices
from .decontaminate import words

#: Bytes of item text in one block; a block's terms are broadcast.
BLOCK_BYTES = 4 << 20
#: Documents of a batch, its term counts, and cells of an item's bitmaps.
BATCH_ROWS, BATCH_COUNTS, CELLS = 4096, 1 << 20, 1 << 24
#: Documents that are scored at once between two looks at the k-th best score.
STEP = 64
#: Slices of tasks that are ranked before the items are.
SLICES = 64


def item_terms(texts: list[str | None]) -> tuple[dict[bytes, int], list[tuple[np.ndarray, np.ndarray]]]:
    """Numbers of the items' terms and, per item, its term numbers and their repeats."""
    vocabulary: dict[bytes, int] = {}
    items = []
    for t in texts:
        c = Counter(vocabulary.setdefault(w, len(vocabulary)) for w in words(t or ""))
        items.append((np.fromiter(c, np.int64, len(c)), np.fromiter(c.values(), np.int64, len(c))))
    return vocabulary, items


def count_terms(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Per text its number of terms; and for all texts in a row the offsets, term
    numbers and counts of the terms in the vocabulary."""
    size, flat, ends = [], [], []
    for t in texts:
        w = words(t) if t else []
        size.append(len(w))
        flat += [k for k in map(vocabulary.get, w) if k is not None]
        ends.append(len(flat))
    row = np.repeat(np.arange(len(texts)), np.diff([0, *ends]))
    key, n = np.unique(row * np.int64(max(1, len(vocabulary))) + np.array(flat, np.int64), return_counts=True)
    row, term = np.divmod(key, max(1, len(vocabulary)))
    return size, np.searchsorted(row, np.arange(len(texts) + 1)), term, n


def term_table(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(id, n, term, tf) of every row of ``docs`` (id, t)."""
    bc = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = docs.schema["id"].dataType.simpleString()

    def run(it):
        for b in slices(it):
            size, offsets, term, tf = count_terms(b.column(1).to_pylist(), bc.value)
            offsets = pa.array(offsets, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], ["id", "n", "term", "tf"])

    return docs.mapInArrow(run, f"id {kind}, n bigint, term array<int>, tf array<bigint>")


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 75 + (75 * n * documents) div total, exactly."""
    if len(n) and 75 * int(n.max()) * documents >= 1 << 63:
        return np.array([25 + 75 * int(x) * documents // total for x in n], np.int64)
    return 25 + 75 * n * documents // max(1, total)


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of the ranges, one after the other."""
    size = ends - starts
    return np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())


class Batch:
    """Contributions of the terms in a batch of documents, by document and by term."""

    def __init__(self, offsets: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, weight: np.ndarray,
                 documents: int, total: int):
        self.size = len(n)
        self.offsets, self.term = offsets, term
        row = np.repeat(np.arange(self.size), np.diff(offsets))
        m = length_norm(n, documents, total)[row]
        self.value = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        order = np.argsort(term, kind="stable")
        self.by_term_row = row[order]
        by_term = term[order]
        first = np.flatnonzero(np.diff(by_term, prepend=-1))
        self.first, self.last = np.zeros(len(weight), np.int64), np.zeros(len(weight), np.int64)
        self.first[by_term[first]], self.last[by_term[first]] = first, np.append(first[1:], len(by_term))
        self.most = np.zeros(len(weight), np.int64)
        if len(first):
            self.most[by_term[first]] = np.maximum.reduceat(self.value[order], first)

    def masks(self, terms: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """(document, 64-bit words of its mask) of documents lo to hi."""
        starts, ends = self.first[terms], self.last[terms]
        row = self.by_term_row[_ranges(starts, ends)]
        bit = np.repeat(np.arange(len(terms)), ends - starts)
        inside = (row >= lo) & (row < hi)
        bits = np.zeros((-(-len(terms) // 64) * 64, hi - lo), bool)
        bits[bit[inside], row[inside] - lo] = True
        return np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T).view("<u8")

    def scores(self, rows: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Scores of some documents; ``repeats`` holds the item's repeats of all terms."""
        starts, ends = self.offsets[rows], self.offsets[rows + 1]
        at = _ranges(starts, ends)
        summed = np.concatenate([[0], np.cumsum(self.value[at] * repeats[self.term[at]])])
        ends = np.cumsum(ends - starts)
        return summed[ends] - summed[np.concatenate([[0], ends[:-1]])]


def grouped(masks: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents with a term, those of one mask together and masks by descending
    greatest score; and each document's greatest score."""
    some = np.flatnonzero(masks.any(axis=1))
    if not len(some):
        return some, some
    m = np.ascontiguousarray(masks[some])
    key = m[:, 0] if m.shape[1] == 1 else m.view(np.dtype((np.void, m.dtype.itemsize * m.shape[1]))).ravel()
    _, one, group = np.unique(key, return_index=True, return_inverse=True)
    bits = np.unpackbits(m[one].view(np.uint8), axis=1, bitorder="little")[:, :len(most)]
    greatest = bits.astype(np.int64) @ most
    order = np.lexsort((group, -greatest[group]))
    return some[order], greatest[group][order]


class Ranking:
    """The k best documents of an item so far, ties by ascending id, nulls first."""

    def __init__(self, k: int):
        self.k, self.rows, self.scored = k, [], 0

    def floor(self) -> int:
        """Documents that score less cannot get in."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def search(self, batch: Batch, terms: np.ndarray, repeats: np.ndarray, weight_of: np.ndarray, ids: list,
               place: np.ndarray) -> None:
        """Evaluate masks until the rest is under the k-th best score.

        ``weight_of`` is a scratch array over all terms, zero before and after;
        ``place`` is the documents' place in the order of ids."""
        most = batch.most[terms] * repeats
        if most.sum() < self.floor():
            return
        weight_of[terms] = repeats
        step = max(1, CELLS // len(terms))
        for lo in range(0, batch.size, step):
            rows, greatest = grouped(batch.masks(terms, lo, min(batch.size, lo + step)), most)
            rows = rows + lo
            for s in range(0, len(rows), STEP):
                if greatest[s] < self.floor():
                    break
                some = rows[s:s + STEP]
                score = batch.scores(some, weight_of)
                self.scored += len(some)
                best = np.lexsort((place[some], -score))[:self.k]
                self.add([(-int(score[b]), ids[some[b]] is not None, ids[some[b]]) for b in best if score[b] >= self.floor()])
        weight_of[terms] = 0

    def add(self, rows: list[tuple]) -> None:
        self.rows = sorted(self.rows + rows, key=lambda r: r if r[1] else (r[0], False))[:self.k]


def _batches(it):
    """Arrow batches cut to BATCH_ROWS documents and about BATCH_COUNTS counts."""
    for b in slices(it, BATCH_ROWS):
        ends = b.column(2).offsets.to_numpy()
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BATCH_COUNTS, "right")) - 1)
            hi = min(hi, b.num_rows)
            yield b.slice(lo, hi - lo)
            lo = hi


def _best_of_tasks(table: DataFrame, items, weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """(item number, id, score): the k best documents of each item in each task."""
    bc = table.sparkSession.sparkContext.broadcast((items, weight))
    kind = table.schema["id"].dataType.simpleString()

    def run(it):
        items, weight = bc.value
        queries = [(t[weight[t] > 0], r[weight[t] > 0]) for t, r in items]
        rankings = [Ranking(k) for _ in queries]
        scratch, arrow_kind = np.zeros(len(weight), np.int64), None
        for b in _batches(it):
            arrow_kind = b.schema.field(0).type
            lists = b.column(2)
            offsets = lists.offsets.to_numpy()
            lo, hi = offsets[0], offsets[-1]
            batch = Batch((offsets - lo).astype(np.int64), lists.values.to_numpy()[lo:hi].astype(np.int64),
                          b.column(3).values.to_numpy()[lo:hi], b.column(1).to_numpy(), weight, documents, total)
            place = np.empty(b.num_rows, np.int64)
            place[pc.sort_indices(b.column(0), null_placement="at_start").to_numpy()] = np.arange(b.num_rows)
            ids = b.column(0).to_pylist()
            for ranking, (terms, repeats) in zip(rankings, queries):
                if len(terms):
                    ranking.search(batch, terms, repeats, scratch, ids, place)
        rows = [(i, r[2], -r[0]) for i, ranking in enumerate(rankings) for r in ranking.rows]
        if rows:
            item, ids, score = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids, arrow_kind), pa.array(score, pa.int64())],
                                             ["item", "id", "score"])

    return table.mapInArrow(run, f"item int, id {kind}, score bigint")


def _ranked(best: DataFrame, k: int, keys: list[str]) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("id").asc())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per item its ``k`` highest-scoring documents with a score above 0:
    ``item_col``, rank (int, from 1), ``id_col``, score; equal scores by ascending id.

    Terms are words of ASCII letters (A-Z lower-cased), digits and code points from
    128 on, of the whole text; the score is an integer form of BM25 with k1 = 0.8 and
    b = 0.75 (see ``weights``, ``length_norm`` and ``Batch``).

    Null and empty texts have no terms, and such items no rows; null ids come first
    among equal scores; repeated documents are documents of their own, repeated
    items each give rows; an empty table of documents or items gives none; other
    columns are not read.  Very long texts are counted whole in one task, with one
    pair of numbers for each of their terms that the block has; very long items
    are held against few documents at a time."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    asked = items.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("t")).where("t is not null")
    item_kind = asked.schema["i"].dataType
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    out = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == block).collect()
        vocabulary, queries = item_terms([r["t"] for r in rows])
        table = materialize(term_table(src, vocabulary), "term-counts")
        documents, total = table.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        # As many rows as the block has terms.
        for r in table.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect():
            df[r["term"]] = r["n"]
        best = _best_of_tasks(table, queries, weights(df, documents), documents, total, k)
        best = best.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES)))
        best = _ranked(_ranked(best, k, ["item", "slice"]).drop("slice", "rank"), k, ["item"])
        names = spark.createDataFrame([(n, r["i"]) for n, r in enumerate(rows)], _names_schema(item_kind))
        part = best.join(F.broadcast(names), "item").select(F.col("name").alias(item_col), "rank", F.col("id").alias(id_col), "score")
        out = part if out is None else out.unionByName(part)
    return out


def _names_schema(kind):
    from pyspark.sql import types as T

    return T.StructType([T.StructField("item", T.IntegerType()), T.StructField("name", kind)])
