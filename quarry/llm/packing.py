"""Operator 9: order-preserving packing by dynamic programming."""

from __future__ import annotations

import zlib
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW = 2048
#: Price of a cut, in padding tokens: at a sentence's end, and elsewhere.
SENTENCE, INSIDE = 2.0, 12.0
#: Price of a sequence that is a shorter power of two, and the shortest used
#: before a partition's end.
SHORT, SHORTEST = 48.0, 256
#: A sentence longer than this also gets cut points this far apart.
GRID = 48
#: Of the sentence ends within so many tokens, one is a cut point.
GAP = 24
#: Tokens that one round of the dynamic programme sees.
ROUND = 1 << 18


def plan(points: list[int], prices: list[float], window: int = WINDOW) -> list[int]:
    """Cut points (the last of ``points`` included) that minimise padding plus
    prices over the stream 0..points[-1].

    A segment of length L costs 0 padding if L is the window, SHORT if it is a
    shorter power of two, else window - L.  best[j] = price[j] + min over i within the window of
    best[i] + pad(p[j] - p[i]); as pad is window - (p[j] - p[i]), the inner
    minimum is that of best[i] + p[i], kept in a monotone queue; lengths that
    are powers of two are looked up."""
    inf = float("inf")
    at = {0: 0}
    pos, best, back = [0], [0.0], [0]
    queue: deque[int] = deque([0])
    key = [0.0]
    powers = [w for k in range(window.bit_length()) if SHORTEST <= (w := 1 << k) < window]
    for p, price in zip(points, prices, strict=True):
        while queue and p - pos[queue[0]] > window:
            queue.popleft()
        cost, frm = inf, -1
        if queue:
            cost, frm = key[queue[0]] + window - p, queue[0]
        for w in powers:
            i = at.get(p - w)
            if i is not None and best[i] + SHORT < cost:
                cost, frm = best[i] + SHORT, i
        cost += price
        j = len(pos)
        pos.append(p)
        best.append(cost)
        back.append(frm)
        key.append(cost + p)
        at[p] = j
        while queue and key[queue[-1]] >= cost + p:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(pos) - 1
    while j > 0:
        cuts.append(pos[j])
        j = back[j]
    return cuts[::-1]


class Packer:
    """Packs a partition's documents in their order, a bounded round of tokens
    at a time: what the last full window of a round leaves goes to the next."""

    def __init__(self, encoder, window: int, end_id: int):
        self.encoder, self.window = encoder, window
        self.end = end_id.to_bytes(4, "little")
        self.docs: list[tuple] = []  # id, bytes not yet packed, tokens before them, all tokens
        self.points: list[int] = []
        self.prices: list[float] = []
        self.total = 0
        self.sequence = 0

    def add(self, doc_id, text: str):
        ids = self.encoder.ids(text)
        marks = self.encoder.sentence_ends(ids, GAP) if len(ids) > GAP else []
        ids = ids.tobytes() + self.end
        n, at, prev = len(ids) >> 2, self.total, 0
        points, prices = self.points, self.prices
        for m in [*marks, n]:
            if m - prev > GRID:
                for g in range(prev + GRID, m - GRID // 2, GRID):
                    points.append(at + g)
                    prices.append(INSIDE)
            if prev < m < n:
                points.append(at + m)
                prices.append(SENTENCE)
                prev = m
        points.append(at + n)
        prices.append(0.0)
        self.docs.append((doc_id, ids, 0, n))
        self.total += n

    def flush(self, last: bool):
        """Rows of pieces; unless ``last``, the final two windows stay."""
        if not self.total:
            return []
        cuts = plan(self.points, self.prices, self.window)
        keep_from = self.total if last else max([c for c in cuts if c <= self.total - 2 * self.window], default=0)
        rows, start, d, before = [], 0, 0, 0
        for c in cuts:
            if c > keep_from:
                break
            offset = 0
            while start < c:
                doc_id, ids, done, n = self.docs[d]
                take = min(len(ids) // 4 - before, c - start)
                piece = ids[4 * before:4 * (before + take)]
                rows.append((doc_id, done + before, take, zlib.crc32(piece), n, self.sequence, offset))
                offset += take
                start += take
                before += take
                if before == len(ids) // 4:
                    d, before = d + 1, 0
            self.sequence += 1
        rest = self.docs[d:]
        if rest and before:
            doc_id, ids, done, n = rest[0]
            rest[0] = (doc_id, ids[4 * before:], done + before, n)
        self.docs = rest
        k = next((i for i, p in enumerate(self.points) if p > start), len(self.points))
        self.points = [p - start for p in self.points[k:]]
        self.prices = self.prices[k:]
        self.total -= start
        return rows


def pack(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
         window: int = WINDOW, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences of at most ``window`` tokens.

    A document's ids are the library's plus ``end_id``; a null or empty text is
    the end id alone.  Windows are cut at documents' or near sentences' ends so
    that padding plus prices of cuts is least (see ``plan``); a long sentence
    may be cut inside.  Order within a partition is kept; nothing is shuffled.
    A sequence is padded to the window unless its length is a power of two.

    One row per piece: ``id_col``, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  Null ids and repeated rows are packed like any other
    row; an empty table gives no row; other columns are not read."""
    kind = docs.schema[id_col].dataType
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    schema = (f"id {kind.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
              "sequence_id bigint, offset bigint")

    def run(it):
        from pyspark import TaskContext

        from .bpe import encoder

        base = TaskContext.get().partitionId() << 36
        packer = Packer(encoder(vocab_path), window, end_id)

        def batch(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], id_type[0])] + [pa.array(c, pa.int64()) for c in cols[1:5]]
                + [pa.array([base + s for s in cols[5]], pa.int64()), pa.array(cols[6], pa.int64())],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        id_type = [None]
        for b in slices(it):
            id_type[0] = b.schema.field(0).type
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                packer.add(i, t)
                if packer.total >= ROUND and (rows := packer.flush(False)):
                    yield batch(rows)
        if rows := packer.flush(True):
            yield batch(rows)

    out = src.mapInArrow(run, schema)
    return out.withColumnRenamed("id", id_col)
