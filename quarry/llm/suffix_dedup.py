"""Operator 5: exact repeated byte strings, by a hash-compared suffix sort.

A 400-byte window is kept or removed as a whole, so each is sent once, inside a
*run*: the consecutive windows of a text whose least K-gram (by hash) is the
same occurrence, the anchor.  Equal windows have their anchors at the same
offset, so they only meet among runs of one anchor hash.

1. Runs are made per text (prefix polynomial hashes, sliding minimum) and
   counted by (anchor, run hash) before they are shuffled.  An anchor that one
   run has once is done; one whose runs are all alike is removed in all of them.
2. For the rest one run of each content is sent with its bytes to its anchor's
   bucket, where the suffixes and the reversed prefixes at the anchors are
   mergesorted; comparisons find the common extension by binary search over
   prefix hashes, and neighbours are compared byte by byte (a collision is
   mended by an exact sort).  Longest common prefixes of neighbours then tell
   for every offset which windows are alike.
3. An anchor with very many different runs is split by window hash instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, row_key, scratch, slices, superseded

#: Bytes of a text that are hashed at once (positions fit the key's low bits).
SEGMENT = 1 << 20
#: Different runs of one anchor that one task sorts; beyond, windows are counted.
GROUP = 20_000
#: Bytes of runs that are sorted at once.
SORT_BYTES = 8 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        a = np.full(max(n, 4096), base, np.uint64)
        a[0] = 1
        _powers[base] = got = np.cumprod(a, dtype=np.uint64)
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xA0761D6478BD642F)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P[i] = sum over j < i of (byte + 1) * base^j, modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start, end) -> np.ndarray:
    """Position-free hash of [start, end)."""
    return (prefix[end] - prefix[start]) * powers(_INVERSE, len(prefix))[start]


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    out, have = a, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def gram(length: int) -> int:
    return max(8, length // 8)


def runs_of(data: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Anchor hash, run hash, first window, windows and anchor offset of runs."""
    k = gram(length)
    out = []
    for at in range(0, max(0, len(data) - length + 1), SEGMENT - length + 1):
        part = data[at:at + SEGMENT]
        p = prefix_hash(part)
        n = len(part) - k + 1
        h = mix(span_hash(p, slice(0, n), slice(k, k + n)))
        key = (h & ~np.uint64(SEGMENT - 1)) | np.arange(n, dtype=np.uint64)
        anchor = (sliding_min(key, length - k + 1) & np.uint64(SEGMENT - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(anchor, prepend=-1))
        count = np.diff(first, append=len(anchor))
        a = anchor[first]
        r = mix(span_hash(p, first, first + count + length - 1) + (a - first).astype(np.uint64) * np.uint64(_BASE))
        out.append((h[a].view(np.int64), r.view(np.int64), first + at, count, a - first))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def extension(prefix: np.ndarray, inverse: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and ``b`` have in common, ``most`` at
    most: binary search over prefix hashes, for all pairs at once."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    pa_, pb_, ia, ib = prefix[a], prefix[b], inverse[a], inverse[b]
    for _ in range(int(high.max(initial=0)).bit_length()):
        mid = (low + high + 1) >> 1
        same = (prefix[a + mid] - pa_) * ia == (prefix[b + mid] - pb_) * ib
        low = np.where(same, mid, low)
        high = np.where(same, high, np.maximum(mid - 1, low))
    return low


def suffix_sort(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes data[starts : starts + sizes] by (group, bytes), and
    the common prefix of each with the one before it (0 at a group's first).

    A bottom-up mergesort that merges all pairs of neighbouring stretches at
    once: an element's place is its rank in its own stretch plus the rank that
    a binary search finds in the other; one comparison takes a logarithmic
    number of hash look-ups.  Neighbours are then compared byte by byte."""
    n = len(starts)
    padded = np.concatenate([data, np.zeros(1, np.uint8)])
    prefix = prefix_hash(padded)
    inverse = powers(_INVERSE, len(prefix))

    def less(x, y, ties):
        """Whether suffix x sorts before y; equal ones go by ``ties``."""
        e = extension(prefix, inverse, starts[x], starts[y], np.minimum(sizes[x], sizes[y]))
        ex, ey = e >= sizes[x], e >= sizes[y]
        cx = np.where(ex, -1, padded[starts[x] + e].astype(np.int16))
        cy = np.where(ey, -1, padded[starts[y] + e].astype(np.int16))
        out = np.where(cx == cy, ties, cx < cy)
        return np.where(group[x] == group[y], out, group[x] < group[y])

    order = np.argsort(group, kind="stable")
    # Stretches never need to reach over a group's end: groups are in order.
    first = np.flatnonzero(np.diff(group[order], prepend=group[order[0]] - 1)) if n else np.zeros(0, np.int64)
    begin = np.repeat(first, np.diff(first, append=n))
    rank = np.arange(n) - begin
    longest = int(np.diff(first, append=n).max(initial=0))
    size_of = np.repeat(np.diff(first, append=n), np.diff(first, append=n))
    width = 1
    while width < longest:
        block = rank // width
        other = np.where(block % 2 == 0, block + 1, block - 1) * width
        live = np.flatnonzero(other < size_of)
        place = np.arange(n)
        x = order[live]
        low = begin[live] + other[live]
        base = low.copy()
        high = np.minimum(begin[live] + other[live] + width, begin[live] + size_of[live])
        left = block[live] % 2 == 0
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            mid = (low[at] + high[at]) >> 1
            # An element of the left stretch goes before equal ones of the right.
            before = less(order[mid], x[at], ~left[at])
            low[at] = np.where(before, mid + 1, low[at])
            high[at] = np.where(before, high[at], mid)
        place[live] = np.minimum(block[live], np.where(left, block[live], block[live] - 1)) * width + begin[live] \
            + (rank[live] - block[live] * width) + (low - base)
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        width *= 2
    lcp = np.zeros(n, np.int64)
    if n > 1:
        a, b = order[:-1], order[1:]
        pair = np.flatnonzero(group[a] == group[b])
        a, b = a[pair], b[pair]
        most = np.minimum(sizes[a], sizes[b])
        lcp[pair + 1] = extension(prefix, inverse, starts[a], starts[b], most)
        if not _verified(padded, starts[a], starts[b], lcp[pair + 1]):
            return _exact_sort(data, starts, sizes, group)
    return order, lcp


def _verified(data, a, b, sizes) -> bool:
    """Whether all pairs have the bytes in common that their hashes say."""
    for i in range(0, len(a), 4096):
        n = sizes[i:i + 4096]
        total = int(n.sum())
        step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        if (data[np.repeat(a[i:i + 4096], n) + step] != data[np.repeat(b[i:i + 4096], n) + step]).any():
            return False
    return True


def _exact_sort(data, starts, sizes, group) -> tuple[np.ndarray, np.ndarray]:
    """The same by comparing bytes, for data on which hashes collide."""
    raw = data.tobytes()
    cut = [raw[s:s + n] for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
    order = np.array(sorted(range(len(cut)), key=lambda i: (group[i], cut[i])), np.int64)
    lcp = np.zeros(len(cut), np.int64)
    for k in range(1, len(cut)):
        x, y = cut[order[k - 1]], cut[order[k]]
        if group[order[k - 1]] == group[order[k]]:
            lcp[k] = next((i for i, (u, v) in enumerate(zip(x, y, strict=False)) if u != v), min(len(x), len(y)))
    return order, lcp


def alike_windows(texts: list[bytes], group: np.ndarray, offset: np.ndarray, count: np.ndarray,
                  repeated: np.ndarray, length: int) -> list[np.ndarray]:
    """Per run, a flag for each of its windows: whether an equal window is in
    another run of its group (or the run itself is ``repeated``)."""
    n = len(texts)
    size = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    right, rcp = suffix_sort(data, begin + offset, size - offset, group)
    back = np.ascontiguousarray(data[::-1])
    left, lcp = suffix_sort(back, len(data) - begin - offset, offset, group)
    rank_r, rank_l = np.empty(n, np.int64), np.empty(n, np.int64)
    rank_r[right], rank_l[left] = np.arange(n), np.arange(n)
    same_r = np.diff(group[right], prepend=-1) == 0
    same_l = np.diff(group[left], prepend=-1) == 0
    flags = np.zeros((n, int(count.max(initial=0))), bool)
    # The window that begins l bytes before the anchor: first is l = offset.
    for l in range(int(offset.max(initial=0)) + 1):
        has = np.flatnonzero((l <= offset) & (offset - l < count))
        if len(has) < 2:
            continue
        class_r = np.cumsum(~(same_r & (rcp >= length - l)))[rank_r[has]]
        class_l = np.cumsum(~(same_l & (lcp >= l)))[rank_l[has]]
        key = class_r * (n + 1) + class_l
        _, inverse, many = np.unique(key, return_inverse=True, return_counts=True)
        flags[has, offset[has] - l] = many[inverse] > 1
    flags |= repeated[:, None]
    return [flags[i, :c] for i, c in enumerate(count.tolist())]


def _spans(flag: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
    return [(start + int(s), start + int(e) - 1 + length) for s, e in zip(edge[::2], edge[1::2], strict=True)]


_RUN = "__k1 bigint, __k2 bigint, a bigint, r bigint, s int, n int, l int"


def _runs(src: DataFrame, length: int) -> DataFrame:
    def run(it):
        for b in slices(it):
            cols: list[list] = [[] for _ in range(7)]
            for k1, k2, t in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                got = runs_of(np.frombuffer(t.encode(), np.uint8), length)
                m = len(got[0])
                cols[0].append(np.full(m, k1, np.int64))
                cols[1].append(np.full(m, k2, np.int64))
                for c, x in zip(cols[2:], got, strict=True):
                    c.append(x)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in flat[:4]] + [pa.array(c.astype(np.int32)) for c in flat[4:]],
                ["__k1", "__k2", "a", "r", "s", "n", "l"])

    return src.select("__k1", "__k2", "t").mapInArrow(run, _RUN)


def _texts(src: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """Runs with their bytes: one pass over the texts that hold any."""
    keys = ["__k1", "__k2"]
    per_text = reps.groupBy(*keys).agg(F.collect_set(F.struct("a", "c", "hot", "s", "n", "l")).alias("runs"))

    def run(it):
        for b in slices(it, 64):
            rows: list[tuple] = []
            for k1, k2, _, t, runs in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                t = t.encode()
                for x in runs:
                    s = x["s"]
                    rows.append((x["a"], x["c"] > 1, x["hot"], k1, k2, s, x["n"], x["l"], t[s:s + x["n"] + length - 1]))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c[0], pa.int64()), pa.array(c[1]), pa.array(c[2]), pa.array(c[3], pa.int64()), pa.array(c[4], pa.int64()),
                     *(pa.array(x, pa.int32()) for x in c[5:8]), pa.array(c[8], pa.binary())],
                    ["a", "many", "hot", "__k1", "__k2", "s", "n", "l", "text"])

    return (src.join(per_text, keys).select(*keys, "id", "t", "runs")
            .mapInArrow(run, "a bigint, many boolean, hot boolean, __k1 bigint, __k2 bigint, s int, n int, l int, text binary"))


def _sorted_spans(texts: DataFrame, length: int) -> DataFrame:
    """Spans of runs that are alone in their content, by suffix sorts of whole
    anchor groups; groups are read in anchor order, some MB at a time."""

    def solve(rows):
        _, group = np.unique(np.array([r[0] for r in rows], np.int64), return_inverse=True)
        n = np.array([r[5] for r in rows], np.int64)
        many = np.array([r[1] for r in rows])
        flags = alike_windows([r[7] for r in rows], group, np.array([r[6] for r in rows], np.int64), n, many, length)
        out = [(r[2], r[3], *p) for r, f in zip(rows, flags, strict=True) if not r[1] for p in _spans(f, r[4], length)]
        c = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()),
                                           pa.array(c[2], pa.int32()), pa.array(c[3], pa.int32())],
                                          ["__k1", "__k2", "s", "e"])

    def run(it):
        rows: list[tuple] = []
        size = 0
        for b in it:
            for r in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if size >= SORT_BYTES and rows[-1][0] != r[0]:
                    yield solve(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r[7])
        if rows:
            yield solve(rows)

    cols = texts.where("not hot").select("a", "many", "__k1", "__k2", "s", "n", "l", "text")
    return (cols.repartition("a").sortWithinPartitions("a")
            .mapInArrow(run, "__k1 bigint, __k2 bigint, s int, e int"))


def _hot_spans(texts: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many different runs: windows are dealt by
    their own hashes and counted before they are shuffled."""

    def run(it):
        for b in slices(it, 64):
            cols: list[list] = [[] for _ in range(6)]
            for a, k1, k2, s, n, l, t in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                data = np.frombuffer(t, np.uint8)
                p = prefix_hash(data)
                i = np.arange(n)
                h = mix(span_hash(p, i, i + length))
                half = mix(span_hash(p, i, i + length // 2) + (l - i).astype(np.uint64) * np.uint64(_BASE))
                for c, x in zip(cols, (np.full(n, a), half.view(np.int64), h.view(np.int64), np.full(n, k1),
                                       np.full(n, k2), s + i), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols],
                                                 ["a", "g", "h", "__k1", "__k2", "s"])

    w = (texts.where("hot").select("a", "__k1", "__k2", "s", "n", "l", "text")
         .mapInArrow(run, "a bigint, g bigint, h bigint, __k1 bigint, __k2 bigint, s bigint"))
    alike = w.groupBy("a", "g", "h").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    return (w.join(alike, ["a", "g", "h"], "left_semi")
            .select("__k1", "__k2", F.col("s").cast("int").alias("s"), F.expr(f"cast(s + {length} as int)").alias("e")))


def repeated_spans(src: DataFrame, length: int, group_rows: int = GROUP) -> DataFrame:
    """(__k1, __k2, spans): byte spans (start, end) of texts ``t`` that are
    covered by a string of ``length`` bytes that starts anywhere else too."""
    with scratch(src.sparkSession, "spans"):
        return materialize(_repeated(src, length, group_rows), "spans")


def _repeated(src: DataFrame, length: int, group_rows: int) -> DataFrame:
    keys = ["__k1", "__k2"]
    runs = materialize(_runs(src, length), "runs")
    # Written tables on both sides of a join let Spark split its hot keys.
    anchors = materialize(runs.groupBy("a").agg(F.count("*").alias("c"), F.min("r").alias("r0"), F.max("r").alias("r1"))
               .where("c > 1").select("a", (F.col("r0") == F.col("r1")).alias("alike")), "anchors")
    live = materialize(runs.join(anchors, "a"), "live")
    superseded(src.sparkSession, "runs")
    superseded(src.sparkSession, "anchors")
    contents = live.groupBy("a", "r").agg(F.count("*").alias("c"), F.min(F.struct(*keys, "s", "n", "l")).alias("f"),
                                          F.first("alike").alias("alike"))
    contents = materialize(contents, "contents")
    # A run that is there twice is removed wherever it is.
    whole = (live.join(contents.where("c > 1").select("a", "r"), ["a", "r"], "left_semi")
             .select(*keys, "s", F.expr(f"s + n - 1 + {length}").alias("e")))
    hot = (contents.where("not alike").groupBy("a").agg(F.count("*").alias("m"))
           .where(F.col("m") > group_rows).select("a", F.lit(True).alias("hot")))
    reps = (contents.where("not alike").join(hot, "a", "left")
            .select("a", "c", F.coalesce("hot", F.lit(False)).alias("hot"), "f.*"))
    texts = materialize(_texts(src, reps, length), "texts")
    spans = whole.unionByName(_sorted_spans(texts, length)).unionByName(_hot_spans(texts, length))
    return spans.groupBy(*keys).agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   group_rows: int = GROUP, carry: bool = False) -> DataFrame:
    """Per document: ``id_col``, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 (of the bytes that are left, joined), and with ``carry``
    these bytes as ``kept_text`` (cut characters dropped) and the whole row as a
    struct ``row``.

    A byte goes if a string of ``length`` bytes around it starts anywhere else,
    in this text or another; texts are judged as given.  Null texts are empty;
    repeated rows are texts of their own and so remove each other; texts shorter
    than ``length`` stay whole; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    row = F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row")
    src = docs.select(k1, k2, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                      *([row] if carry else []))
    more = f", kept_text string, row {src.schema['row'].dataType.simpleString()}" if carry else ""
    spans = repeated_spans(src, length, group_rows)

    def run(it):
        for b in slices(it):
            out: list[tuple] = []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t, left, at, gone, n = t.encode(), [], 0, 0, 0
                for s, e in sorted((x["s"], x["e"]) for x in found or ()):
                    if s > at or not n:
                        left.append(t[at:s])
                        n += 1
                        at = s
                    gone += max(0, e - at)
                    at = max(at, e)
                left.append(t[at:])
                left = b"".join(left)
                out.append((len(t), gone, n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
            c = list(zip(*out, strict=True)) or [[]] * 5
            arrays = [b.column(0)] + [pa.array(x, pa.int64()) for x in c[:3]] + [pa.array(x, pa.string()) for x in c[3:]]
            yield pa.RecordBatch.from_arrays(arrays + [b.column(3)] if carry else arrays[:5], names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text", "row"] * carry
    out = (src.join(spans, ["__k1", "__k2"], "left").select("id", "t", "spans", *["row"] * carry)
           .mapInArrow(run, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + more))
    return out.withColumnRenamed("id", id_col)


def without_repeats(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All columns of the documents, their texts without repeated strings;
    documents of which no word is left go, unless they had none."""
    out = remove_repeats(docs, text_col=text_col, carry=True, **options)
    out = out.where((F.col("n_removed") == 0) | F.col("kept_text").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[F.col("kept_text").alias(c) if c == text_col else F.col("row").getField(c).alias(c)
                        for c in docs.columns])
