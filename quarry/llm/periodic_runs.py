"""Operator 11: periodic runs of words by a dictionary of basic factors.

A basic factor is a stretch of 2**k words.  Factors that occur more than once in
their document are numbered level by level: a factor's number comes from those
of its two halves.  On each level a factor whose next occurrence lies within
twice its length, at distance d, is a term of an arithmetic progression and
proposes the period d.  A proposal is extended to both sides by common
extensions, read off the same numbers in descending levels, and equal stretches
are one run with the least period.

Whether all runs are proposed: let a run have least period q and at least 3 * q
words, and let 2**k be the least power of two that is not under q, so that
2**k < 2 * q.  The factor of that length at the run's start recurs q words on,
inside the run, and not before: a nearer occurrence would make the word of the
period a power.  So level k proposes q.

The words of many documents are numbered in one pass of array operations; a
factor's number holds its document, so that matches never cross documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Words that are taken together; a longer document is taken alone.
WORDS = 1 << 17
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Levels = list[np.ndarray]


def words(text: str) -> list[str]:
    return _WORD.findall(text)


def factors(names: np.ndarray, ends: np.ndarray, longest: int) -> tuple[Levels, list[tuple[np.ndarray, np.ndarray]]]:
    """Numbers of the factors and, per level, (place, distance) of each factor whose
    next occurrence proposes a period.

    ``names`` number the words, differently in each document; ``ends`` is the end
    of each word's document.  A level is an array over all places, -1 where the
    factor does not recur or does not fit.  Levels stop where nothing recurs or
    factors are longer than ``longest``."""
    levels: Levels = []
    proposals = []
    at, key, size = np.arange(len(names)), names, 1
    while True:
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        if not same.any():
            break
        place = at[order]
        gap = place[1:] - place[:-1]
        near = same & (gap <= 2 * size)
        proposals.append((place[:-1][near], gap[near]))
        recurs = np.zeros(len(at), bool)
        recurs[:-1] |= same
        recurs[1:] |= same
        number = np.concatenate([[0], np.cumsum(~same)])
        level = np.full(len(names), -1, np.int32)
        level[place[recurs]] = number[recurs]
        levels.append(level)
        if 2 * size > longest:
            break
        at = np.sort(place[recurs])
        at = at[at + 2 * size <= ends[at]]
        second = level[at + size]
        at, second = at[second >= 0], second[second >= 0]
        key = level[at].astype(np.int64) * (int(number[-1]) + 1) + second
        size *= 2
    return levels, proposals


def common_extensions(levels: Levels, i: np.ndarray, j: np.ndarray, starts: np.ndarray,
                      ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that i and j (i < j, same document) have in common before and from on."""
    a, b, left, right = i.copy(), j.copy(), starts[i], ends[i]
    for k in range(len(levels) - 1, -1, -1):
        # A factor of the top level may be followed by another that matches too.
        moved, step = np.ones(len(a), bool), np.int64(1 << k)
        while moved.any():
            ok = moved & (b + step <= right)
            x, y = np.where(ok, a, 0), np.where(ok, b, 0)
            moved = ok & (levels[k][x] >= 0) & (levels[k][x] == levels[k][y])
            a, b = a + moved * step, b + moved * step
            if k < len(levels) - 1:
                break
    forward = a - i
    a, b = i.copy(), j.copy()
    for k in range(len(levels) - 1, -1, -1):
        moved, step = np.ones(len(a), bool), np.int64(1 << k)
        while moved.any():
            ok = moved & (a - step >= left)
            x, y = np.where(ok, a - step, 0), np.where(ok, b - step, 0)
            moved = ok & (levels[k][x] >= 0) & (levels[k][x] == levels[k][y])
            a, b = a - moved * step, b - moved * step
            if k < len(levels) - 1:
                break
    return i - a, forward


def runs_of(names: np.ndarray, starts: np.ndarray, ends: np.ndarray, shortest: int,
            least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs of at least ``shortest`` words and
    ``least`` >= 3 periods, by start and period; starts are places in ``names``."""
    none = np.empty(0, np.int64)
    if not len(names):
        return none, none, none
    longest = 2 * int((ends - starts).max()) // least
    levels, proposals = factors(names, ends, max(1, longest))
    if not proposals:
        return none, none, none
    place = np.concatenate([p for p, _ in proposals])
    gap = np.concatenate([g for _, g in proposals])
    # Terms at following places with one distance propose the same stretch.
    order = np.lexsort((place, gap))
    place, gap = place[order], gap[order]
    first = np.ones(len(place), bool)
    first[1:] = (gap[1:] != gap[:-1]) | (place[1:] != place[:-1] + 1)
    place, gap = place[first], gap[first]
    if not len(place):
        return none, none, none
    back, forward = common_extensions(levels, place, place + gap, starts, ends)
    start, length = place - back, back + gap + forward
    enough = (length >= shortest) & (length >= least * gap)
    start, length, gap = start[enough], length[enough], gap[enough]
    order = np.lexsort((gap, length, start))
    start, length, gap = start[order], length[order], gap[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, gap = start[keep], length[keep], gap[keep]
    order = np.lexsort((gap, start))
    return start[order], length[order], gap[order]


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """Run of the greatest exact length / period; the first of ties."""
    top = None
    for r in runs:
        if top is None or r[1] * top[2] > top[1] * r[2]:
            top = r
    return top


def _document_slices(ids: list, texts: list, rewrite) -> Iterator[tuple[list[list[str]], int, int]]:
    """Word lists of following rows, together about WORDS words, and the rows' range."""
    held, total, lo = [], 0, 0
    for i, t in enumerate(texts):
        w = words(t) if t else []
        source = rewrite(ids[i], len(w)) if rewrite and w else None
        if source is not None:
            w = [w[k] for k in source.tolist()]
        held.append(w)
        total += len(w)
        if total >= WORDS:
            yield held, lo, i + 1
            held, total, lo = [], 0, i + 1
    if held:
        yield held, lo, len(texts)


def _detect(held: list[list[str]], shortest: int, least: int):
    """Runs of each word list, and the words outside later periods."""
    sizes = np.array([len(w) for w in held], np.int64)
    n = int(sizes.sum())
    codes, uniques = pd.factorize(np.array([x for w in held for x in w], object)) if n else (np.empty(0, np.int64), [])
    document = np.repeat(np.arange(len(held)), sizes)
    ends = np.repeat(np.cumsum(sizes), sizes)
    starts = ends - np.repeat(sizes, sizes)
    s, length, q = runs_of(codes + document * np.int64(len(uniques)), starts, ends, shortest, least)
    # Words after the first period of a run: differences summed up.
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, s + q, 1)
    np.add.at(cover, s + length, -1)
    dropped = np.cumsum(cover[:-1]) > 0
    base = np.concatenate([[0], np.cumsum(sizes)])
    lo = np.searchsorted(s, base)
    for d, w in enumerate(held):
        a, b = lo[d], lo[d + 1]
        if a == b:
            yield w, []
            continue
        out = dropped[base[d]:base[d + 1]].tolist()
        yield [x for x, gone in zip(w, out) if not gone], list(zip((s[a:b] - base[d]).tolist(), length[a:b].tolist(), q[a:b].tolist()))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 24, least: int = 3,
                  rewrite: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """Per row: ``id_col``, runs (array of start, length, period, by start and
    period), best (the run of greatest length / period, ties by start and
    period; null without runs), collapsed (the text's words without those that a
    run holds after its first period, joined by one space).

    A run is a stretch of at least ``shortest`` words and ``least`` (3 or more)
    periods that no neighbouring word extends.  ``rewrite`` may give, for an id
    and a number of words, the places whose words stand in for the text's own.

    A null or empty text has no words and no runs; a null id is passed on; repeated
    rows each give a row; an empty table gives none; other columns are not read.
    A text is taken whole in one task, with some 40 bytes a word and 4 more for
    each level on which factors recur; very long texts are taken alone.  One
    pass, no shuffle."""
    if least < 3:
        raise ValueError("least must be 3 or more")
    kind = docs.schema[id_col].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(it):
        for b in slices(it, 1024):
            for held, lo, hi in _document_slices(b.column(0).to_pylist(), b.column(1).to_pylist(), rewrite):
                runs, best, kept = [], [], []
                for w, found in _detect(held, shortest, least):
                    runs.append([dict(zip(("start", "length", "period"), r)) for r in found])
                    top = _best(found)
                    best.append(top and dict(zip(("start", "length", "period"), top)))
                    kept.append(" ".join(w))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, hi - lo), pa.array(runs, pa.list_(run_type)), pa.array(best, run_type),
                     pa.array(kept, pa.string())], ["id", "runs", "best", "collapsed"])

    fields = "struct<start: bigint, length: bigint, period: bigint>"
    out = src.mapInArrow(run, f"id {kind}, runs array<{fields}>, best {fields}, collapsed string")
    return out.withColumnRenamed("id", id_col)


def planted(doc_id, n: int) -> np.ndarray | None:
    """Places whose words make a tenth of the documents periodic from a place on."""
    if doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def digests(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, the best run and SHA-256 digests of ``periodic_runs``' rows."""
    def line(r: Column) -> Column:
        return F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","),
                        r["period"].cast("string"), F.lit("\n"))

    b = F.col("best")
    return runs.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), b["start"].alias("start"), b["length"].alias("length"),
        b["period"].alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
