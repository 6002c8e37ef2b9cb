"""Similarity joins and searches.

Three kernels carry every operator here:

* ``set_join`` — exact similarity join over token sets.  Tokens of one row only
  are dropped, tokens of the same rows go as one with a weight.  With a threshold it
  uses prefix filtering: tokens are ordered globally by document frequency
  (rarest first) and a set of size ``n`` only indexes its first
  ``n - ceil(t·n) + 1`` tokens; two sets with Jaccard ≥ t must share one of
  those, so the candidate join never touches the frequent tokens that make
  all-pairs blow up.  Candidates are verified exactly.  Without a threshold
  it is the plain inverted-index join (join on token →
  ``groupBy(q, d).sum(weight)``), which emits only overlapping pairs.
* ``best_match`` — the most similar set of each set without a threshold, by
  rounds of falling thresholds and bounds from tokens not yet looked at.
* ``block_pairs`` — both sides of a dense all-pairs sum cut into hash blocks
  of bounded size that meet by an equi-join on the block id; the query side is
  broadcast only when its measured size is under the limit.  Nearest neighbours
  over vectors are in ``neighbors``.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Sequence
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import r6
from ..session import cut_lineage, shared_uri
from .neighbors import dense_radius, dense_topk  # noqa: F401

# ---------------------------------------------------------------- tokens


def words(text: Column) -> Column:
    """Lower-cased whitespace words (empty dropped)."""
    return F.filter(F.split(F.lower(text), "[ \t\r\n]+"), lambda t: F.length(t) > 0)


def token_id(s: Column) -> Column:
    """60-bit token id: first 15 hex digits of md5.  DuckDB:
    ``('0x' || substr(md5(s), 1, 15))::UBIGINT::BIGINT``."""
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


#: Bytes that part words, as blanks.
_BLANKS = bytes.maketrans(b"\t\r\n", b"   ")


def shingles(text: Column, n: int = 3) -> Column:
    """Sorted distinct ids (``token_id``) of the word n-grams of a text (a text shorter
    than n words is one shingle; an empty text has none).  An Arrow batch of lower-cased
    texts at a time: each different n-gram of a text is hashed once."""
    @F.arrow_udf("array<bigint>")
    def run(texts: pa.Array) -> pa.Array:
        ids, ends, null = [], [0], []
        for t in texts.cast(pa.binary()).to_pylist():
            w = [] if t is None else [x for x in t.translate(_BLANKS).split(b" ") if x]
            if len(w) < n:
                grams = {b" ".join(w)} if w else set()
            else:
                grams = set(map(b" ".join, zip(*[w[i:] for i in range(n)])))
            # The first 15 of 32 hex digits, as one big-endian number.
            u = np.frombuffer(b"".join([md5(g).digest() for g in grams]), ">u8")[::2] >> 4
            ids.append(np.unique(u.astype(np.int64)))
            ends.append(ends[-1] + len(ids[-1]))
            null.append(t is None)
        values = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array(null, pa.bool_()))

    return run(F.lower(text))


# ---------------------------------------------------------------- D01


def sim_from_counts(inter: Column, na: Column, nb: Column, metric: str = "tanimoto") -> Column:
    """Tanimoto |∩|/(a+b−|∩|), Dice 2|∩|/(a+b), cosine |∩|/√(ab); 0 when the
    denominator is 0."""
    inter, na, nb = inter.cast("double"), na.cast("double"), nb.cast("double")
    if metric == "tanimoto":
        den = na + nb - inter
        num = inter
    elif metric == "dice":
        den = na + nb
        num = 2 * inter
    elif metric == "cosine":
        den = F.sqrt(na * nb)
        num = inter
    else:
        raise ValueError(metric)
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def set_similarity(a: Column, b: Column, metric: str = "tanimoto") -> Column:
    """D01 on two distinct-token arrays."""
    return sim_from_counts(F.size(F.array_intersect(a, b)), F.size(a), F.size(b), metric)


def dense_cosine(a: Column, b: Column) -> Column:
    """Cosine of two numeric arrays; 0 when a norm is 0."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    na = F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    nb = F.aggregate(b, F.lit(0.0), lambda s, v: s + v * v)
    den = F.sqrt(na) * F.sqrt(nb)
    return F.when(den > 0, dot / den).otherwise(F.lit(0.0))


# ---------------------------------------------------------------- D03 kernel (sparse)


def _jaccard_floor(threshold: float, metric: str) -> float:
    """Lowest Jaccard a pair can have when ``metric ≥ threshold``."""
    if metric == "tanimoto":
        return threshold
    if metric == "dice":
        return threshold / (2 - threshold)
    if metric == "cosine":
        return threshold * threshold
    raise ValueError(metric)


def _sets(df: DataFrame, id_col: str, tok_col: str, p: str) -> DataFrame:
    return df.select(F.col(id_col).alias(f"{p}id"), F.col(tok_col).alias(f"{p}toks")).withColumn(
        f"{p}n", F.size(f"{p}toks"))


#: Rows of a frequency table that a join may broadcast (24 bytes each).
_SMALL = 500_000


#: Bits of the map of tokens that several rows may have, at least and at most (16 MB, 128 MB), parts it is
#: made in, first bits of a token's code that are compared, and codes that a task sorts at once.
_MAP_BITS, _MAP_MOST, _MAP_PARTS, _CODE_BITS, _CODES = 27, 30, 1024, 37, 1 << 21


def _gaps(ascending: np.ndarray) -> bytes:
    """The differences of ascending numbers under 2^32, their bytes in four planes: the high
    ones are zeros, which compress."""
    gaps = np.diff(ascending.astype(np.int64), prepend=0)
    return gaps.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_gaps(raw: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def _token_codes(toks: Column) -> Column:
    """64 bits of hash of each different token, null tokens left out."""
    return F.transform(F.array_distinct(F.filter(toks, lambda t: t.isNotNull())), lambda t: F.xxhash64(t))


def _shared_map(df: DataFrame, tok_col: str) -> tuple[int, bytes]:
    """A bit map by the first bits of a token's code, set for every token that is in two
    rows or more (and for a few that are not), and the number of these bits: enough that
    an eighth are set.  Tasks send some 2 bytes a token and row, sorted and dealt by the
    code's first 10 bits."""
    deal = (_MAP_PARTS - 1).bit_length()
    low, fine = _CODE_BITS - deal, _MAP_MOST - deal

    def split(it):
        def parts(held):
            code = np.sort(np.concatenate(held).view(np.uint64) >> np.uint64(64 - _CODE_BITS))
            at = np.searchsorted(code, np.arange(_MAP_PARTS + 1, dtype=np.uint64) << np.uint64(low))
            code &= np.uint64((1 << low) - 1)
            k = np.flatnonzero(at[1:] > at[:-1])
            return pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([_gaps(code[at[i]:at[i + 1]]) for i in k], pa.binary())],
                                              ["part", "codes"])

        held, size = [], 0
        for b in it:
            held.append(b.column(0).flatten().to_numpy(zero_copy_only=False))
            size += len(held[-1])
            if size >= _CODES:
                yield parts(held)
                held, size = [], 0
        if size:
            yield parts(held)

    def repeated(table: pa.Table) -> pa.Table:
        code = np.sort(np.concatenate([_from_gaps(x) for x in table["codes"].to_pylist()]))
        place = np.unique(code[1:][code[1:] == code[:-1]] >> (low - fine))
        return pa.table({"part": table["part"][:1], "n": pa.array([len(place)], pa.int64()), "places": pa.array([zlib.compress(_gaps(place), 1)], pa.binary())})

    codes = df.select(_token_codes(F.col(tok_col)).alias("c"))
    sent = codes.mapInArrow(split, "part int, codes binary")
    found = [tuple(r) for r in sent.groupBy("part").applyInArrow(repeated, "part int, n bigint, places binary").toLocalIterator()]
    bits = min(max(_MAP_BITS, (8 * sum(n for _, n, _ in found)).bit_length()), _MAP_MOST)
    out = np.zeros((_MAP_PARTS, 1 << (bits - deal - 3)), np.uint8)
    for part, n, places in found:
        if n:
            has = np.zeros(1 << (bits - deal), bool)
            has[_from_gaps(zlib.decompress(places)) >> (_MAP_MOST - bits)] = True
            out[part] = np.packbits(has)
    return bits, out.tobytes()


def _kept(df: DataFrame, tok_col: str, floor: float = 0.0) -> Column:
    """The different tokens of a row that ``_shared_map`` has; null if these are less than
    the share ``floor`` of its different tokens."""
    first, shared = _shared_map(df, tok_col)
    shared = df.sparkSession.sparkContext.broadcast(shared)

    @F.arrow_udf(df.schema[tok_col].dataType)
    def run(toks: pa.Array, codes: pa.Array) -> pa.Array:
        at = codes.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - first)
        bits = np.frombuffer(shared.value, np.uint8)
        has = (bits[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8) & 1).astype(bool)
        size = codes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(size)])
        few = np.diff(np.concatenate([[0], np.cumsum(has)])[ends]) < np.ceil(size * floor - 1e-9)
        has &= ~np.repeat(few, size)
        upto = np.concatenate([[0], np.cumsum(has)])[ends]
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), toks.flatten().filter(pa.array(has)), mask=pa.array(few))

    toks = F.array_distinct(F.filter(tok_col, lambda t: t.isNotNull()))
    return run(toks, _token_codes(F.col(tok_col)))


#: The rows that can meet others.
_FILLED = "id is not null and n > 0 and toks is not null"


def _rows(df: DataFrame, id_col: str, tok_col: str, alone: bool = False, floor: float = 0.0) -> DataFrame:
    """``_all_rows`` with an id and a token."""
    return _all_rows(df, id_col, tok_col, alone, floor).where(_FILLED)


def _all_rows(df: DataFrame, id_col: str, tok_col: str, alone: bool = False, floor: float = 0.0) -> DataFrame:
    """(row, id, n, key, toks) of the rows, written once: sets are read several times.  ``row`` numbers the rows, ``key`` is the same for equal sets.
    When the rows meet one another ``alone``, most tokens that are in one row only stay
    out of ``toks``: a first pass over ``df`` tells them.  Rows with less than the share ``floor``
    of their tokens left, which reach that Jaccard similarity with no other row, have none."""
    d = df.select(F.col(id_col).alias("id"), F.col(tok_col).alias("toks"))
    toks = _kept(d, "toks", floor) if alone else F.col("toks")
    # A filter comes after: before, it would make the tokens twice.
    return cut_lineage(d.select(F.monotonically_increasing_id().alias("row"), "id", F.size("toks").alias("n"),
                                F.when(toks.isNotNull(), F.unhex(F.md5(F.to_json(F.array_sort("toks"))))).alias("key"),
                                toks.alias("toks")))


def _members(rows: DataFrame) -> DataFrame:
    """(node, id, n): the rows of each different set; the node is its first row."""
    least = rows.groupBy("key").agg(F.min("row").alias("node"))
    return cut_lineage(rows.select("key", "id", "n").join(least, "key").select("node", "id", "n"))


def _token_classes(q: DataFrame, d: DataFrame | None) -> DataFrame:
    """(side, row, n, tok, df, w): the tokens that can be in common (in two rows of ``q``, or
    on both sides), those in the same rows as one, ``tok``, of weight ``w``.  Tokens in one
    row only, most of a text's, cost one pass for their frequency and one to drop out; rows
    of a token are compared by 128 bits of hash."""
    def exploded(x: DataFrame, side: int) -> DataFrame:
        return x.select(F.lit(side).alias("side"), "row", "n", F.explode(F.array_distinct("toks")).alias("tok"))

    if d is None:
        # One shuffle gives frequencies, marks and rows: both readers below need all columns, and the
        # same filter.
        each = Window.partitionBy("tok")
        post = exploded(q, 0).where("tok is not null").withColumn("df", F.count("*").over(each)).where("df > 1")
    else:
        fq = cut_lineage(exploded(q, 0).groupBy("tok").agg(F.count("*").alias("fq")))
        if fq.count() <= _SMALL:
            fq = F.broadcast(fq)
        dp = exploded(d, 1).join(fq, "tok")
        freq = dp.groupBy("tok").agg((F.first("fq") + F.count("*")).alias("df"))
        post = exploded(q, 0).join(freq, "tok").unionByName(dp.drop("fq").join(freq, "tok"))
    marks = post.groupBy("tok", "df").agg(F.bit_xor(F.xxhash64("side", "row", "n")).alias("m1"),
                                          F.bit_xor(F.xxhash64("n", "row", "side", F.lit(1))).alias("m2"))
    classes = marks.groupBy("df", "m1", "m2").agg(F.min("tok").alias("tok"), F.count("*").alias("w")).select("tok", "w")
    return post.join(classes, "tok").select("side", "row", "n", "tok", "df", "w")


def _levels(classes: DataFrame, top: int) -> DataFrame:
    """(side, row, levels): level j holds the tokens whose weight has bit j, so that the
    weight in common is a sum of 2^j times a count."""
    packed = classes.groupBy("side", "row").agg(F.collect_list(F.struct("tok", "w")).alias("s"))

    def level(j: int) -> Column:
        return F.transform(F.filter("s", lambda x: F.getbit(x["w"], F.lit(j)) == 1), lambda x: x["tok"])

    return packed.select("side", "row", F.array(*[level(j) for j in range(top)]).alias("levels"))


def _node_join(classes: DataFrame, t: float, self_join: bool) -> DataFrame:
    """(a, b, an, bn, inter) of nodes whose Jaccard similarity may reach ``t``, a < b in a
    self-join; ``inter`` is exact.

    Tokens are ordered by frequency, rare first, and ``rest`` is the weight of a node's
    token and all after it: a pair must share a token with ``rest`` of at least its
    overlap, on both sides, and the first token in common shows it."""
    w = Window.partitionBy("side", "row").orderBy(F.desc("df"), F.desc("tok")).rowsBetween(Window.unboundedPreceding, 0)
    classes = cut_lineage(classes.withColumn("rest", F.sum("w").over(w)))
    top = classes.agg(F.max("w")).first()[0] or 1
    c = F.col
    prefix = classes.where(c("rest") >= F.ceil(c("n") * F.lit(t) - F.lit(1e-9)))

    def side(x: DataFrame, k: int, p: str, cols: Sequence[str]) -> DataFrame:
        return x.where(c("side") == (0 if self_join else k)).select(
            *[c(v).alias(p if v == "row" else v if v == "tok" else f"{p}{v}") for v in cols])

    cols = ["row", "n", "tok", "rest"]
    least = F.ceil((c("an") + c("bn")) * F.lit(t / (1 + t)) - F.lit(1e-9))
    cand = (side(prefix, 0, "a", cols).join(side(prefix, 1, "b", cols), "tok")
            .where((c("bn") >= c("an") * F.lit(t) - F.lit(1e-9)) & (c("an") >= c("bn") * F.lit(t) - F.lit(1e-9))
                   & (F.least("arest", "brest") >= least)))
    if self_join:
        cand = cand.where("a < b")
    cand = cand.select("a", "b", "an", "bn").distinct()
    levels = _levels(classes, int(top).bit_length())
    both = (cand.join(side(levels, 0, "a", ["row", "levels"]), "a").join(side(levels, 1, "b", ["row", "levels"]), "b"))
    inter = F.lit(0).cast("bigint")
    for j in range(int(top).bit_length()):
        inter = inter + F.size(F.array_intersect(c("alevels")[j], c("blevels")[j])) * F.lit(1 << j).cast("bigint")
    return both.select("a", "b", "an", "bn", inter.alias("inter"))


#: Tokens of rows in a block of the overlap product, at most, and what a task looks at at once.
_BLOCK, _CELLS = 1 << 22, 1 << 22


def _blocks_of(rows: DataFrame, nodes: DataFrame, count: int) -> dict[int, str]:
    """Files of a shared folder, by block, of the nodes (row, n, entries) and their tokens (row,
    toks) dealt to ``count`` blocks.  The i-th node, in the order of the first ids, has size n[i]
    and the entries ends[i] … ends[i + 1] − 1 of ids, m and c (``_entries``); token tok[k] is in
    the nodes node[at[j]:at[j + 1]] with j = kind[k]: tokens in the same nodes are compared by 128
    bits of hash and share one list."""
    folder = shared_uri(rows.sparkSession, "blocks")
    block = F.pmod(F.xxhash64("row"), F.lit(count)).cast("int").alias("block")

    def pack(sets: pa.Table, nodes: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        sets, nodes = sets.combine_chunks(), nodes.combine_chunks()
        if not len(nodes):
            return pa.table({"block": pa.array([], pa.int32()), "uri": pa.array([], pa.string())})
        nodes = nodes.take(pc.sort_indices(pc.list_element(nodes["entries"], 0).combine_chunks().field("id")))
        row, of = (x["row"].to_numpy() for x in (nodes, sets))
        order = np.argsort(row)
        place = np.minimum(np.searchsorted(row, of, sorter=order), len(row) - 1)
        place = np.where(row[order[place]] == of, order[place], -1)
        toks = sets["toks"].combine_chunks()
        node = np.repeat(place, toks.value_lengths().to_numpy(zero_copy_only=False))
        tok = toks.flatten().to_numpy(zero_copy_only=False)[node >= 0]
        node = node[node >= 0]
        order = np.argsort(tok, kind="stable")
        tok, first = np.unique(tok[order], return_index=True)
        node, sizes = node[order], np.diff(np.append(first, len(order)))
        marks = np.random.default_rng(7).integers(0, 1 << 64, (2, len(row)), np.uint64, False)
        marks = [np.add.reduceat(m[node], first) if len(first) else m[:0] for m in marks]
        order = np.lexsort(marks)
        new = np.ones(len(order), bool)
        new[1:] = np.any([np.diff(m[order]) != 0 for m in marks], axis=0)
        kind = np.empty(len(order), np.int64)
        kind[order] = np.cumsum(new) - 1
        lists = order[new]
        e = nodes["entries"].combine_chunks()
        flat = {"m": e.flatten().field("m"), "c": e.flatten().field("c"), "ends": np.append(0, np.cumsum(e.value_lengths())), "n": nodes["n"],
                "tok": tok, "kind": kind.astype(np.int32), "at": np.append(0, np.cumsum(sizes[lists])),
                "node": node[_spans(first[lists], sizes[lists])].astype(np.int32)}
        held = {"ids": e.flatten().field("id"), **{c: pa.array(np.asarray(x)) for c, x in flat.items()}}
        batch = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in held.values()], list(held))
        uri = f"{folder}/{uuid.uuid4().hex}.arrow"
        fs, path = pafs.FileSystem.from_uri(uri)
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        with fs.open_output_stream(path) as out, pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as to:
            to.write_batch(batch)
        return pa.table({"block": nodes["block"][:1], "uri": pa.array([uri])})

    dealt = [x.select(block, *cols).groupBy("block") for x, cols in ((rows, ("row", "toks")), (nodes, ("row", "n", "entries")))]
    return {r["block"]: r["uri"] for r in dealt[0].cogroup(dealt[1]).applyInArrow(pack, "block int, uri string").collect()}


class _Block:
    """A block of ``_blocks_of`` as arrays."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        with fs.open_input_stream(path) as held:
            batch = pa.ipc.open_stream(held).read_next_batch()
        for c in batch.schema.names:
            x = batch.column(c).flatten()
            setattr(self, c, x if c == "ids" else x.to_numpy())


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, … of each span, one after another."""
    upto = np.cumsum(sizes)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(starts - (upto - sizes), sizes)


def _overlaps(a: _Block, b: _Block, same: bool):
    """Batches (i, j, inter) of the nodes of two blocks with a token in common; i < j within
    the same block.  A batch covers so many nodes of ``a`` that its cells, or its tokens in
    common, are at most ``_CELLS`` (one node at least)."""
    _, ka, kb = np.intersect1d(a.tok, b.tok, assume_unique=True, return_indices=True)
    # Tokens in the same nodes of both blocks go as one, with a weight.
    both, weight = np.unique(a.kind[ka].astype(np.int64) * len(b.at) + b.kind[kb], return_counts=True)
    ka, kb = both // len(b.at), both % len(b.at)
    sizes = a.at[ka + 1] - a.at[ka]
    node, k, weight = a.node[_spans(a.at[ka], sizes)].astype(np.int64), np.repeat(kb, sizes), np.repeat(weight, sizes)
    order = np.argsort(node, kind="stable")
    node, k, weight = node[order], k[order], weight[order]
    many, wide = b.at[k + 1] - b.at[k], len(b.n)
    upto = np.concatenate([[0], np.cumsum(many)])
    first = np.searchsorted(node, np.arange(len(a.n) + 1))
    i = 0
    while i < len(a.n):
        # The nodes i … j − 1: by tokens in common, as many as fit, and no more cells than fit.
        j = int(np.searchsorted(upto[first], upto[first[i]] + _CELLS, "right")) - 1
        j = min(max(i + 1, j), i + max(1, _CELLS // wide), len(a.n))
        at = slice(first[i], first[j])
        cell = np.repeat((node[at] - i) * wide, many[at]) + b.node[_spans(b.at[k[at]], many[at])]
        w = np.repeat(weight[at], many[at])
        if len(cell) * 16 > (j - i) * wide:
            total = np.bincount(cell, w, (j - i) * wide)
            cell = np.flatnonzero(total)
            inter = total[cell].astype(np.int64)
        else:
            cell, back = np.unique(cell, return_inverse=True)
            inter = np.bincount(back, w, len(cell)).astype(np.int64)
        left, right = cell // wide + i, cell % wide
        if same:
            up = left < right
            left, right, inter = left[up], right[up], inter[up]
        if len(left):
            yield left, right, inter
        i = j


def _entry_pairs(a: _Block, b: _Block, left: np.ndarray, right: np.ndarray):
    """Batches (pair, ia, ib) of the entries of both nodes of each pair."""
    la, lb = (np.diff(x.ends)[y] for x, y in ((a, left), (b, right)))
    if (la == 1).all() and (lb == 1).all():
        yield np.arange(len(left)), a.ends[left], b.ends[right]
        return
    for at in np.split(np.arange(len(left)), np.flatnonzero(np.diff(np.cumsum(la * lb) // _CELLS)) + 1):
        pair, ia = np.repeat(at, la[at]), _spans(a.ends[left[at]], la[at])
        for part in np.split(np.arange(len(pair)), np.flatnonzero(np.diff(np.cumsum(lb[pair]) // _CELLS)) + 1):
            many = lb[pair[part]]
            yield np.repeat(pair[part], many), np.repeat(ia[part], many), _spans(b.ends[right[pair[part]]], many)


def _overlap_product(rows: DataFrame, nodes: DataFrame, each, schema: str) -> DataFrame:
    """``each(a, b, same)`` of all pairs of blocks, as rows of ``schema``: nodes are dealt to blocks
    that are written once, each pair of blocks is a row of its own, whose task reads the two, and
    pairs of nodes are made and counted inside of it, so that neither pairs nor blocks are shuffled."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.size("toks"))).first()[0] or 0
    # Pairs of blocks for all cores, some times over.
    some = math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism))
    count = max(math.ceil(size / _BLOCK), min(some, math.ceil(size / 65536)), 1)
    uris = _blocks_of(rows, nodes, count)
    pairs = [(x, y) for x in sorted(uris) for y in sorted(uris) if x <= y]

    def run(it):
        held = {}
        for batch in it:
            for i in batch.column(0).to_pylist():
                x, y = pairs[i]
                held = {k: held[k] if k in held else _Block(uris[k]) for k in (x, y)}
                yield from each(held[x], held[y], x == y)

    return spark.range(0, len(pairs), 1, max(1, min(len(pairs), 10_000))).mapInArrow(run, schema)


def _each_pair(emit):
    """``emit(a, b, ia, ib, an, bn, inter)`` of the entries of all pairs of nodes with a token in common."""
    def each(a, b, same):
        for left, right, inter in _overlaps(a, b, same):
            for pair, ia, ib in _entry_pairs(a, b, left, right):
                yield emit(a, b, ia, ib, a.n[left[pair]], b.n[right[pair]], inter[pair])

    return each


def _sims(inter: np.ndarray, an: np.ndarray, bn: np.ndarray, metric: str) -> np.ndarray:
    """``sim_from_counts`` of arrays."""
    den = {"tanimoto": an + bn - inter, "dice": an + bn, "cosine": np.sqrt(an * bn)}[metric]
    return np.where(den > 0, (2 if metric == "dice" else 1) * inter / np.where(den > 0, den, 1), 0.0)


def _each_best(metric: str):
    """The most similar node of each node of two blocks, by their first ids (ties: smaller id)."""
    def each(a, b, same):
        blocks = (a, b)
        top = [np.zeros(len(x.n)) for x in blocks]
        who = [np.full(len(x.n), -1) for x in blocks]
        if same:
            top[1], who[1] = top[0], who[0]
        for left, right, inter in _overlaps(a, b, same):
            sim = _sims(inter, a.n[left], b.n[right], metric)
            order = np.argsort(right, kind="stable")
            for k, (mine, other, s) in enumerate(((left, right, sim), (right[order], left[order], sim[order]))):
                first = np.flatnonzero(np.diff(mine, prepend=-1))
                most = np.repeat(np.maximum.reduceat(s, first), np.diff(np.append(first, len(mine))))
                at = np.flatnonzero(s == most)
                at = at[np.diff(mine[at], prepend=-1) != 0]
                m, o, v = mine[at], other[at], s[at]
                better = (v > top[k][m]) | (v == top[k][m]) & (o < who[k][m])
                top[k][m[better]], who[k][m[better]] = v[better], o[better]
        for k in range(1 if same else 2):
            have = np.flatnonzero((who[k] >= 0) & (top[k] > 0))
            mine, other = (x.ids.take(pa.array(x.ends[i])) for x, i in ((blocks[k], have), (blocks[1 - k], who[k][have])))
            yield pa.RecordBatch.from_arrays([mine, other, pa.array(top[k][have])], ["qid", "did", "sim"])

    return each


def _entries(rows: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(node, id, n, m): the ids of each different set of ``_rows`` and their numbers of rows, and
    the rows, of which those that are a node have the set's tokens.  None if an id has two
    different sets."""
    least = rows.groupBy("key").agg(F.min("row").alias("node"))
    entries = cut_lineage(rows.groupBy("key", "id", "n").agg(F.count("*").alias("m")).join(least, "key").select("node", "id", "n", "m"))
    if not entries.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        return None
    return entries, rows


def _node_entries(entries: DataFrame) -> DataFrame:
    """(row, n, entries) of (node, n, id, m, c), entries in order."""
    return entries.groupBy(F.col("node").alias("row")).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("id", "m", "c"))).alias("entries"))


def _overlapping(entries: DataFrame, rows: DataFrame, strict_upper: bool) -> DataFrame:
    """(qid, did, inter, qn, dn) of the rows with a token in common.  As in a join by token
    and ids, ``inter`` is times the rows of both ids, and so many rows come out."""
    c, kind = F.col, entries.schema["id"].dataType
    nodes = _node_entries(entries.withColumn("c", F.lit(1).cast("bigint")))

    def emit(a, b, ia, ib, an, bn, inter):
        times = a.m[ia] * b.m[ib]
        return pa.RecordBatch.from_arrays([a.ids.take(pa.array(ia)), b.ids.take(pa.array(ib)), pa.array(inter * times),
                                           pa.array(an.astype(np.int32)), pa.array(bn.astype(np.int32)), pa.array(times)],
                                          ["qid", "did", "inter", "qn", "dn", "times"])

    k = kind.simpleString()
    out = _overlap_product(rows, nodes, _each_pair(emit), f"qid {k}, did {k}, inter bigint, qn int, dn int, times bigint")
    turned = [c("did").alias("qid"), c("qid").alias("did"), "inter", c("dn").alias("qn"), c("qn").alias("dn"), "times"]
    copies = entries.join(entries.groupBy("node").agg(F.count("*").alias("k")).where("k > 1").select("node"), "node", "left_semi")
    alike = copies.select("node", c("id").alias("qid"), c("n").alias("qn"), "m").join(
        copies.select("node", c("id").alias("did"), c("m").alias("dm")), "node").where("qid < did").select(
        "qid", "did", (c("qn") * c("m") * c("dm")).alias("inter"), "qn", c("qn").alias("dn"), (c("m") * c("dm")).alias("times"))
    if strict_upper:
        flip = c("qid") > c("did")
        out = out.select(*[F.when(flip, c(y)).otherwise(c(x)).alias(x) for x, y in (("qid", "did"), ("did", "qid"))], "inter",
                         *[F.when(flip, c(y)).otherwise(c(x)).alias(x) for x, y in (("qn", "dn"), ("dn", "qn"))], "times").unionByName(alike)
    else:
        out = out.unionByName(alike)
        out = out.select(F.inline(F.array(F.struct(*out.columns), F.struct(*turned))))
    return out.select("qid", "did", "inter", "qn", "dn", F.explode(F.array_repeat(F.lit(0), c("times").cast("int")))).drop("col")


def overlap_sums(df: DataFrame, id_col: str, tok_col: str = "toks", metric: str = "tanimoto",
                 rows: DataFrame | None = None) -> DataFrame:
    """(s1, s2): sums of the similarity and of its square over the pairs of ``set_join``
    without a threshold, one partial sum a batch of pairs.  ``rows``: ``_rows`` of ``df``, if written."""
    found = _entries(_rows(df, id_col, tok_col, True) if rows is None else rows)
    if found is None:
        pairs = set_join(df, df, id_col, id_col, tok_col, 0.0, metric, self_join=True)
        return pairs.agg(F.sum("sim").alias("s1"), F.sum(F.col("sim") * F.col("sim")).alias("s2"))
    c = F.col
    # Ids of as many rows are one entry.
    kinds = cut_lineage(found[0].groupBy("node", "n", "m").agg(F.count("*").alias("c")))
    nodes = _node_entries(kinds.withColumn("id", F.lit(0)))

    def emit(a, b, ia, ib, an, bn, inter):
        times = (a.m[ia] * b.m[ib]).astype(float)
        sim = _sims(inter * times, an, bn, metric)
        weight = times * a.c[ia] * b.c[ib]
        return pa.RecordBatch.from_arrays([pa.array([float(weight @ sim)]), pa.array([float(weight @ (sim * sim))])], ["s1", "s2"])

    apart = _overlap_product(found[1], nodes, _each_pair(emit), "s1 double, s2 double")
    alike = kinds.join(kinds.select("node", c("m").alias("m2"), c("c").alias("c2")), "node").where("m <= m2").withColumns({
        "pairs": (F.when(c("m") == c("m2"), c("c") * (c("c") - 1) / 2).otherwise(c("c") * c("c2")) * c("m") * c("m2")).cast("double"),
        "sim": sim_from_counts(c("n") * c("m") * c("m2"), c("n"), c("n"), metric)}).where("pairs > 0")
    alike = alike.select((c("pairs") * c("sim")).alias("s1"), (c("pairs") * c("sim") * c("sim")).alias("s2"))
    return apart.unionByName(alike).agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))


def set_join(q: DataFrame, d: DataFrame, q_id: str, d_id: str, tok_col: str = "toks",
             threshold: float = 0.0, metric: str = "tanimoto", self_join: bool = False,
             strict_upper: bool = True, materialize: bool = True) -> DataFrame:
    """Exact similarity join of token sets.

    Returns ``qid, did, inter, qn, dn, sim`` for every pair with at least one
    common token and ``sim ≥ threshold``.  ``self_join`` (q is d) keeps
    ``qid < did`` when ``strict_upper`` else ``qid <> did``.  With a threshold
    equal sets are joined once and their rows paired at the end.
    """
    c = F.col

    def apart(df: DataFrame) -> DataFrame:
        if not self_join:
            return df
        return df.where(c("qid") < c("did")) if strict_upper else df.where(c("qid") != c("did"))

    if threshold <= 0:
        found = _entries(_rows(q, q_id, tok_col, True)) if materialize and self_join else None
        if found is not None:
            out = _overlapping(*found, strict_upper)
        elif materialize:
            qs = _rows(q, q_id, tok_col)
            ds = None if self_join else _rows(d, d_id, tok_col)
            tok = _token_classes(qs, ds)
            sides = [tok.where(c("side") == k).select("tok", "w", "row") for k in ((0, 0) if self_join else (0, 1))]
            ds = qs if self_join else ds
            qe = sides[0].join(qs.select("row", c("id").alias("qid")), "row").select("qid", "tok", "w")
            de = sides[1].join(ds.select("row", c("id").alias("did")), "row").select("did", "tok")
            pairs = apart(qe.join(de, "tok")).groupBy("qid", "did").agg(F.sum("w").alias("inter"))
            out = pairs.join(qs.select(c("id").alias("qid"), c("n").alias("qn")), "qid").join(
                ds.select(c("id").alias("did"), c("n").alias("dn")), "did")
        else:
            qs = _sets(q, q_id, tok_col, "q")
            ds = _sets(q if self_join else d, q_id if self_join else d_id, tok_col, "d")
            pairs = apart(qs.select("qid", F.explode("qtoks").alias("tok")).join(
                ds.select("did", F.explode("dtoks").alias("tok")), "tok")).groupBy("qid", "did").agg(F.count("*").alias("inter"))
            out = pairs.join(qs.select("qid", "qn"), "qid").join(ds.select("did", "dn"), "did")
    else:
        floor = _jaccard_floor(threshold, metric)
        qs = _rows(q, q_id, tok_col, self_join, floor)
        ds = None if self_join else _rows(d, d_id, tok_col)
        qm = _members(qs)
        dm = qm if self_join else _members(ds)
        qn = qs.join(qm.select(c("node").alias("row")).distinct(), "row", "left_semi")
        dn = None if self_join else ds.join(dm.select(c("node").alias("row")).distinct(), "row", "left_semi")
        pairs = _node_join(_token_classes(qn, dn), floor, self_join)
        pairs = cut_lineage(pairs.where(sim_from_counts(c("inter"), c("an"), c("bn"), metric) >= F.lit(threshold)))
        left, right = qm.select(c("node").alias("a"), c("id").alias("qid")), dm.select(c("node").alias("b"), c("id").alias("did"))
        out = pairs.join(left, "a").join(right, "b").select("qid", "did", "inter", c("an").alias("qn"), c("bn").alias("dn"))
        if self_join:
            # a < b are nodes: their rows go both ways; rows of one node are equal
            turned = out.select(c("did").alias("qid"), c("qid").alias("did"), "inter", c("dn").alias("qn"), c("qn").alias("dn"))
            many = qm.groupBy("node").agg(F.count("*").alias("m")).where("m > 1").select("node")
            copies = qm.join(many, "node", "left_semi")
            alike = copies.select("node", c("id").alias("qid"), c("n").alias("qn")).join(
                copies.select("node", c("id").alias("did")), "node")
            out = apart(out.unionByName(turned).unionByName(alike.select(
                "qid", "did", c("qn").cast("bigint").alias("inter"), "qn", c("qn").alias("dn"))))
    out = out.withColumn("sim", sim_from_counts(c("inter"), c("qn"), c("dn"), metric))
    if threshold > 0:
        out = out.where(c("sim") >= F.lit(threshold))
    return out.select("qid", "did", "inter", "qn", "dn", "sim")


def top_k(pairs: DataFrame, k: int, key: str = "qid", other: str = "did", score: str = "sim",
          descending: bool = True) -> DataFrame:
    """Best k per ``key`` by score (ties: smaller ``other`` first), with rank."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    w = Window.partitionBy(key).orderBy(order, F.col(other))
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(q_row: DataFrame, d: DataFrame, q_id: str, d_id: str, tok_col: str = "toks",
           k: int = 10, threshold: float = 0.0, metric: str = "tanimoto") -> DataFrame:
    """One query set against a table, sim ≥ threshold, best k (sim desc,
    id): one scan with the query's tokens as a literal, no shuffle of the table."""
    row = q_row.select(F.col(q_id).alias("qid"), tok_col).first()
    kind = q_row.schema[q_id].dataType
    toks = F.lit([] if row is None or row[1] is None else row[1]).cast(d.schema[tok_col].dataType)
    out = d.select(F.lit(None if row is None else row["qid"]).cast(kind).alias("qid"), F.col(d_id).alias("did"),
                   F.size(F.array_intersect(tok_col, toks)).cast("bigint").alias("inter"), F.size(toks).alias("qn"),
                   F.size(tok_col).alias("dn")).where("inter > 0")
    out = out.withColumn("sim", sim_from_counts(F.col("inter"), F.col("qn"), F.col("dn"), metric))
    if threshold > 0:
        out = out.where(F.col("sim") >= F.lit(threshold))
    return out.orderBy(F.col("sim").desc(), F.col("did")).limit(k)


#: Falling thresholds of the rounds after which settled rows leave ``best_match``.
ROUNDS = (0.8, 0.5)
#: Sets that a token may be in to be counted pair by pair in the last round.
HOT = 1000


def _nodes(df: DataFrame, id_col: str, tok_col: str) -> DataFrame:
    """(id, toks, other): each different set once with its two smallest ids."""
    w = Window.partitionBy("toks").orderBy("id")
    return (df.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(tok_col)).alias("toks"))
            .withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("toks")
            .agg(F.min("id").alias("id"), F.max(F.when(F.col("r") == 2, F.col("id"))).alias("other"))
            .select("id", "toks", "other"))


def _ordered(nodes: DataFrame, freq: DataFrame) -> DataFrame:
    """(id, n, toks as (df, tok), rare first)."""
    ex = nodes.select("id", F.size("toks").alias("n"), F.explode("toks").alias("tok")).join(freq, "tok")
    return ex.groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "tok"))).alias("s"))


def best_match(q: DataFrame, d: DataFrame, q_id: str, d_id: str, tok_col: str = "toks", metric: str = "tanimoto",
               self_join: bool = False, seen: list | None = None) -> DataFrame:
    """The most similar set of ``d`` for every set of ``q``: ``qid, did, sim`` (ties: smaller
    id); rows without an overlapping set are left out.  ``self_join``: q is d, a
    row is not its own match.  Exact, without a threshold:

    1. Equal sets are one node; in a self-join, copies match at 1.
    2. Rounds of falling thresholds join by prefixes; a row whose best match reaches
       the round's threshold is settled and leaves.
    3. For the rest, common tokens are counted pair by pair but for tokens in more
       than ``HOT`` sets.  A row with h hot tokens has at most h more in common
       with any set: pairs whose bound beats the row's best are verified.  A set that
       shares nothing but one hot token is no better than the smallest set with that
       token, which is tried for each row.  Only rows whose best is under the bound
       of several hot tokens alone are joined on these, with sets short enough.

    ``seen`` takes the numbers of candidate pairs, by step."""
    dn = cut_lineage(_nodes(d, d_id, tok_col))
    qn = dn if self_join else cut_lineage(_nodes(q, q_id, tok_col))
    freq = dn.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("df"))
    # Tokens that only one set, or one side, has match nothing: they count in the size only.
    freq = freq.where("df > 1") if self_join else freq.join(
        qn.select(F.explode("toks").alias("tok")).distinct(), "tok", "left_semi")
    freq = cut_lineage(freq)
    ds = cut_lineage(_ordered(dn, freq))
    qs = ds if self_join else cut_lineage(_ordered(qn, freq).drop("n").join(
        qn.select("id", F.size("toks").alias("n")), "id"))
    c = F.col
    qrow = qs.select(c("id").alias("qid"), c("n").alias("qn"), c("s").alias("qs"))
    drow = ds.select(c("id").alias("did"), c("n").alias("dn"), c("s").alias("ds"))
    apart = (c("qid") != c("did")) if self_join else F.lit(True)

    def tally(pairs: DataFrame) -> DataFrame:
        if seen is None:
            return pairs
        pairs = cut_lineage(pairs)
        seen.append(pairs.count())
        return pairs

    def verified(pairs: DataFrame) -> DataFrame:
        """(qid, did, sim) of pairs (qid, did)."""
        inter = F.size(F.array_intersect(F.transform("qs", lambda x: x["tok"]), F.transform("ds", lambda x: x["tok"])))
        return (tally(pairs).join(qrow, "qid").join(drow, "did")
                .select("qid", "did", sim_from_counts(inter, c("qn"), c("dn"), metric).alias("sim")).where("sim > 0"))

    def best(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("qid").orderBy(c("sim").desc(), "did")
        return found.withColumn("r", F.row_number().over(w)).where("r = 1").select("qid", "sim", "did")

    def prefix(rows: DataFrame, p: str, t: float) -> DataFrame:
        # Tokens left out would come first in the order.
        size = F.greatest(F.size(f"{p}s") - F.ceil(c(f"{p}n") * F.lit(t) - F.lit(1e-9)) + 1, F.lit(0))
        return rows.select(f"{p}id", f"{p}n", F.explode(F.slice(f"{p}s", 1, size.cast("int"))).alias("e")).select(
            f"{p}id", f"{p}n", c("e.tok").alias("tok"))

    done, left = [], qrow
    if self_join:
        copies = dn.where(c("other").isNotNull() & (F.size("toks") > 0))
        done.append(copies.select(c("id").alias("qid"), F.lit(1.0).alias("sim"), c("other").alias("did")))
        left = cut_lineage(qrow.join(copies.select(c("id").alias("qid")), "qid", "left_anti"))
    for t in ROUNDS:
        j = _jaccard_floor(t, metric)
        pairs = (prefix(left, "q", j).join(prefix(drow, "d", j), "tok")
                 .where((c("dn") >= c("qn") * F.lit(j) - F.lit(1e-9)) & (c("qn") >= c("dn") * F.lit(j) - F.lit(1e-9)) & apart)
                 .select("qid", "did").distinct())
        settled = cut_lineage(best(verified(pairs).where(c("sim") >= F.lit(t))))
        done.append(settled)
        left = cut_lineage(left.join(settled.select("qid"), "qid", "left_anti"))
    # The two smallest sets with each token: a row's first guess by its last token.
    w = Window.partitionBy("tok").orderBy("dn", "did")
    small = (drow.select("did", "dn", F.explode(F.transform("ds", lambda x: x["tok"])).alias("tok"))
             .withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r"))
    last = left.where(F.size("qs") > 0).select("qid", F.element_at("qs", -1)["tok"].alias("tok"))
    guess = last.join(small, "tok").where(apart).select("qid", "did").distinct()
    cold = F.filter("qs", lambda x: x["df"] <= HOT)
    hot = F.size("qs") - F.size(cold)
    cold_d = F.filter("ds", lambda x: x["df"] <= HOT)
    pairs = tally(left.select("qid", F.explode(F.transform(cold, lambda x: x["tok"])).alias("tok"))
                  .join(drow.select("did", F.explode(F.transform(cold_d, lambda x: x["tok"])).alias("tok")), "tok")
                  .where(apart).groupBy("qid", "did").agg(F.count("*").alias("inter")))
    sizes = left.select("qid", "qn", hot.alias("hot"))
    least = sim_from_counts(c("inter"), c("qn"), c("dn"), metric)
    bound = sim_from_counts(F.least(c("inter") + c("hot"), c("qn"), c("dn")), c("qn"), c("dn"), metric)
    counted = cut_lineage(pairs.join(sizes, "qid").join(drow.select("did", "dn"), "did")
                          .select("qid", "did", "hot", least.alias("sim"), bound.alias("bound")))
    exact = counted.where("hot = 0").select("qid", "did", "sim")
    open_ = counted.where("hot > 0")
    first = open_.join(best(open_.select("qid", "did", "bound").withColumnRenamed("bound", "sim")).select("qid", "did"), ["qid", "did"], "left_semi")
    have = cut_lineage(best(exact.unionByName(verified(first.select("qid", "did").union(guess).distinct()))))
    more = open_.join(have.select("qid", c("sim").alias("have")), "qid", "left").where(
        F.coalesce(c("bound") >= c("have"), F.lit(True))).select("qid", "did")
    have = cut_lineage(best(have.select("qid", "did", "sim").unionByName(verified(more))))
    # Rows that several hot tokens alone could still match better.
    alone = sim_from_counts(c("hot"), c("qn"), F.greatest("hot", F.lit(1)), metric)
    late = left.join(have.select("qid", c("sim").alias("have")), "qid", "left").withColumn("hot", hot).where("hot > 1").where(
        F.coalesce(alone >= c("have"), F.lit(True)))
    late = cut_lineage(late.select("qid", "qn", "hot", "have", F.explode(F.transform(F.filter("qs", lambda x: x["df"] > HOT), lambda x: x["tok"])).alias("tok")))
    if not late.isEmpty():
        reach = sim_from_counts(F.least(c("hot"), c("dn")), c("qn"), c("dn"), metric)
        hot_d = drow.select("did", "dn", F.explode(F.transform(F.filter("ds", lambda x: x["df"] > HOT), lambda x: x["tok"])).alias("tok"))
        rest = late.join(hot_d, "tok").where(apart & F.coalesce(reach >= c("have"), F.lit(True))).select("qid", "did").distinct()
        have = best(have.select("qid", "did", "sim").unionByName(verified(rest)))
    done.append(have)
    out = done[0].select("qid", "did", "sim")
    for x in done[1:]:
        out = out.unionByName(x.select("qid", "did", "sim"))
    # Back to the rows: copies of a set share its match.
    node = q.select(F.col(q_id).alias("row"), F.array_sort(F.array_distinct(tok_col)).alias("toks")).join(
        qn.select(c("id").alias("qid"), "toks"), "toks").select("row", "qid")
    out = node.join(out, "qid")
    if self_join:  # the first copy's match is the second, of all others the first
        out = out.withColumn("did", F.when(c("row") != c("qid"), c("qid")).otherwise(c("did")))
    return out.select(c("row").alias("qid"), "did", "sim")


def nearest_neighbor(df: DataFrame, id_col: str, tok_col: str = "toks",
                     metric: str = "tanimoto") -> DataFrame:
    """The most similar other row of each row; rows without any
    overlapping neighbour get (−1, 0.0).  Sets are compared inside pairs of blocks
    (``_overlap_product``), of which each node's best leaves; copies match at 1.  If an id has two
    different sets, ``best_match`` is used."""
    c = F.col
    sets = df.select(id_col, F.array_sort(F.array_distinct(tok_col)).alias(tok_col))
    found = _entries(_rows(sets, id_col, tok_col, True))
    if found is None:
        best = best_match(df, df, id_col, id_col, tok_col, metric, self_join=True)
    else:
        entries, rows = found
        kind = entries.schema["id"].dataType.simpleString()
        two = entries.withColumn("c", F.row_number().over(Window.partitionBy("node").orderBy("id"))).where("c <= 2")
        nodes = cut_lineage(_node_entries(two))
        first, second = F.get("entries", F.lit(0)), F.get("entries", F.lit(1))
        other = F.when(first["m"] > 1, first["id"]).otherwise(second["id"])
        near = _overlap_product(rows, nodes, _each_best(metric), f"qid {kind}, did {kind}, sim double")
        near = near.groupBy("qid").agg(F.min(F.struct((-c("sim")).alias("away"), "did")).alias("b"))
        near = nodes.select(c("row").alias("node"), first["id"].alias("qid"), other.alias("other")).join(near, "qid", "left")
        # The first copy's match is the second, of all others the first.
        copy = F.when(c("id") == c("qid"), c("other")).otherwise(c("qid"))
        has = c("other").isNotNull()
        best = entries.join(near, "node").select(c("id").alias("qid"), F.when(has, copy).otherwise(c("b")["did"]).alias("did"),
                                                 F.when(has, 1.0).otherwise(-c("b")["away"]).alias("sim"), "m")
        best = best.select("qid", "did", "sim", F.explode(F.array_repeat(F.lit(0), c("m").cast("int")))).drop("col")
    best = best.select(c("qid").alias(id_col), c("did").alias("neighbor_id"), c("sim").alias("similarity"))
    return df.select(id_col).join(best, id_col, "left").select(
        id_col, F.coalesce("neighbor_id", F.lit(-1).cast("bigint")).alias("neighbor_id"),
        F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def similarity_matrix(df: DataFrame, id_col: str, tok_col: str = "toks",
                      metric: str = "tanimoto") -> DataFrame:
    """Symmetric matrix in long form (i ≤ j), diagonal 1; zero pairs implicit."""
    pairs = set_join(df, df, id_col, id_col, tok_col, 0.0, metric, self_join=True)
    diag = df.select(F.col(id_col).alias("i"), F.col(id_col).alias("j"), F.lit(1.0).alias("sim"))
    return pairs.select(F.col("qid").alias("i"), F.col("did").alias("j"), "sim").unionByName(diag)


def pairwise_stats(df: DataFrame, id_col: str, tok_col: str = "toks",
                   metric: str = "tanimoto") -> DataFrame:
    """Mean / population std of the similarity over all pairs i<j of a
    table, zero-overlap pairs included, pairs whose union is empty
    skipped — without emitting the zero pairs: their count is closed-form."""
    sets = _all_rows(df, id_col, tok_col, True)
    counts = sets.agg(F.count("*").alias("m"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("z"))
    s = overlap_sums(df, id_col, tok_col, metric, sets.where(_FILLED))
    n_pairs = (F.col("m") * (F.col("m") - 1) / 2 - F.col("z") * (F.col("z") - 1) / 2)
    mean = F.coalesce(F.col("s1"), F.lit(0.0)) / n_pairs
    var = F.coalesce(F.col("s2"), F.lit(0.0)) / n_pairs - mean * mean
    s_row = s.select(F.struct("s1", "s2").alias("st")).scalar()
    return counts.withColumn("s1", F.lit(s_row["s1"])).withColumn("s2", F.lit(s_row["s2"])).select(
        n_pairs.cast("bigint").alias("n_pairs"),
        F.when(n_pairs > 0, mean).alias("mean_similarity"),
        F.when(n_pairs > 0, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("std_similarity"))


def coverage(train: DataFrame, test: DataFrame, train_id: str, test_id: str, tok_col: str = "toks",
             metric: str = "tanimoto") -> DataFrame:
    """Max similarity of each test row to the training rows, summarised."""
    best = best_match(test, train, test_id, train_id, tok_col, metric).select("qid", F.col("sim").alias("max_sim"))
    per = test.select(F.col(test_id).alias("qid")).join(best, "qid", "left").select(
        F.coalesce("max_sim", F.lit(0.0)).alias("s"))
    return per.agg(F.count("*").alias("n_test"), F.avg("s").alias("mean_max_similarity"),
                   F.avg(F.when(F.col("s") > 0.5, 1.0).otherwise(0.0)).alias("share_above_0_5"),
                   F.avg(F.when(F.col("s") > 0.7, 1.0).otherwise(0.0)).alias("share_above_0_7"),
                   F.avg(F.when(F.col("s") < 0.3, 1.0).otherwise(0.0)).alias("share_below_0_3"))


def activity_cliffs(df: DataFrame, id_col: str, act_col: str, tok_col: str = "toks",
                    threshold: float = 0.7, min_ratio: float = 10.0, cap: int | None = None) -> DataFrame:
    """Pairs i<j with sim ≥ threshold, both activities > 0 and
    max/min ≥ min_ratio, by ratio desc.  ``cap`` keeps only pairs inside
    each row's best ``cap`` neighbours (the reference's top-50 window)."""
    pairs = set_join(df, df, id_col, id_col, tok_col, threshold, "tanimoto", self_join=True)
    if cap is not None:
        both = pairs.select("qid", "did", "sim").unionByName(
            pairs.select(F.col("did").alias("qid"), F.col("qid").alias("did"), "sim"))
        keep = top_k(both, cap).select(F.least("qid", "did").alias("qid"),
                                       F.greatest("qid", "did").alias("did")).distinct()
        pairs = pairs.join(keep, ["qid", "did"], "left_semi")
    a = df.select(F.col(id_col).alias("qid"), F.col(act_col).cast("double").alias("act_i"))
    b = df.select(F.col(id_col).alias("did"), F.col(act_col).cast("double").alias("act_j"))
    out = pairs.join(a, "qid").join(b, "did").where((F.col("act_i") > 0) & (F.col("act_j") > 0))
    out = out.withColumn("ratio", F.greatest("act_i", "act_j") / F.least("act_i", "act_j"))
    return out.where(F.col("ratio") >= min_ratio).select(
        F.col("qid").alias("id_i"), F.col("did").alias("id_j"), "sim", "act_i", "act_j", "ratio")


def char_set(text: Column) -> Column:
    """The different characters of a text, in order, as one string."""
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if t is None else "".join(sorted(set(t))) for t in texts.to_pylist()], pa.string())

    return run(text)


def char_diff_label(c1: Column, c2: Column) -> Column:
    """D11 transformation label from the difference of two ``char_set``
    ('-removed+added', '+added', '-removed' or 'similar'); characters sorted."""
    added = F.call_function("translate", c2, c1, F.lit(""))
    removed = F.call_function("translate", c1, c2, F.lit(""))
    return (F.when((F.length(added) > 0) & (F.length(removed) > 0), F.concat(F.lit("-"), removed, F.lit("+"), added))
            .when(F.length(added) > 0, F.concat(F.lit("+"), added))
            .when(F.length(removed) > 0, F.concat(F.lit("-"), removed))
            .otherwise(F.lit("similar")))


def matched_pairs(df: DataFrame, id_col: str, text_col: str, act_col: str, tok_col: str = "toks",
                  min_similarity: float = 0.7) -> DataFrame:
    """Pairs i<j with min ≤ sim < 1, delta = act_j − act_i, label.  The characters of
    a text are taken once a row, not once a pair."""
    pairs = set_join(df, df, id_col, id_col, tok_col, min_similarity, "tanimoto", self_join=True)
    pairs = pairs.where(F.col("sim") < 1.0)
    chars = char_set(F.col(text_col))
    a = df.select(F.col(id_col).alias("qid"), chars.alias("t_i"), F.col(act_col).cast("double").alias("a_i"))
    b = df.select(F.col(id_col).alias("did"), chars.alias("t_j"), F.col(act_col).cast("double").alias("a_j"))
    j = pairs.join(a, "qid").join(b, "did")
    return j.select(F.col("qid").alias("id_i"), F.col("did").alias("id_j"), "sim",
                    (F.col("a_j") - F.col("a_i")).alias("delta"),
                    char_diff_label(F.col("t_i"), F.col("t_j")).alias("transformation"))


def transformation_summary(pairs: DataFrame) -> DataFrame:
    """Mean effect and count per transformation label."""
    return pairs.groupBy("transformation").agg(F.avg("delta").alias("mean_delta"),
                                               F.count("*").alias("n_pairs"))


def suggest(pairs: DataFrame, target: float = 0.0, n: int = 5) -> DataFrame:
    """First n pairs whose delta exceeds the target (deterministic order)."""
    return (pairs.where(F.col("delta") > target).orderBy("id_i", "id_j").limit(n)
            .select("id_i", "id_j", "transformation", "delta",
                    F.concat(F.lit("transform "), F.col("transformation"), F.lit(": +"),
                             F.format_number("delta", 2)).alias("suggestion")))


def group_hopping(query: DataFrame, db: DataFrame, id_col: str, group_col: str, count_col: str,
                  same_count: bool = True) -> DataFrame:
    """Rows of ``db`` in a different group; with ``same_count`` also the
    same secondary count (equi-join on the count, ``<>`` residual)."""
    q = query.select(F.col(id_col).alias("query_id"), F.col(group_col).alias("q_group"),
                     F.col(count_col).alias("q_count"))
    cond = F.col("q_group") != F.col(group_col)
    if same_count:
        cond = (F.col("q_count") == F.col(count_col)) & cond
    return q.join(db, cond).select("query_id", F.col(id_col).alias("hit_id"), F.col(group_col).alias("hit_group"),
                                   F.col(count_col).alias("hit_count"))


# ---------------------------------------------------------------- D08 / D09


def zscore_stats(df: DataFrame, cols: Sequence[str], sample: bool = False) -> DataFrame:
    std = F.stddev_samp if sample else F.stddev_pop
    return df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[std(c).alias(f"s_{c}") for c in cols])


def zscale(df: DataFrame, stats: DataFrame, cols: Sequence[str], out: str = "vec") -> DataFrame:
    """Vector column of z-scores (std 0 → 1) with the stats broadcast as a
    one-row literal."""
    row = stats.first()
    zs = []
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        s = 1.0 if (s is None or s == 0 or math.isnan(s)) else s
        zs.append((F.col(c).cast("double") - F.lit(m)) / F.lit(s))
    return df.withColumn(out, F.array(*zs))


def property_search(df: DataFrame, id_col: str, cols: Sequence[str], target: dict[str, float],
                    k: int = 5) -> DataFrame:
    """score = Σ|(x − t)/std| (population std, 0 → 1; the reference's
    sqrt-of-square makes it L1), NaN/null → 1e10, best k."""
    st = zscore_stats(df, cols).first()
    terms = []
    for c in cols:
        s = st[f"s_{c}"]
        s = 1.0 if (s is None or s == 0 or math.isnan(s)) else s
        terms.append(F.abs((F.col(c).cast("double") - F.lit(float(target[c]))) / F.lit(s)))
    score = terms[0]
    for t in terms[1:]:
        score = score + t
    score = F.when(score.isNull() | F.isnan(score), F.lit(1e10)).otherwise(score)
    return df.withColumn("distance", score).orderBy("distance", id_col).limit(k)


# ---------------------------------------------------------------- dense blocks


def _blocks(df: DataFrame, id_col: str, vec_col: str, n_blocks: int, tag: str) -> DataFrame:
    """Hash blocks: one row per block with flat ``ids`` and row-major
    ``vals`` arrays (aligned: both come from the same collected list)."""
    g = (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
         .withColumn(f"{tag}blk", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
         .groupBy(f"{tag}blk").agg(F.collect_list(F.struct("id", "v")).alias("rows")))
    return g.select(f"{tag}blk", F.struct(F.transform("rows", lambda r: r["id"]).alias("ids"),
                                          F.flatten(F.transform("rows", lambda r: r["v"])).alias("vals"))
                    .alias(f"{tag}rows"))


def block_pairs(q: DataFrame, d: DataFrame, q_id: str, d_id: str, vec_col: str, block_rows: int = 2048,
                broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(qrows, drows) block pairs: both sides cut into hash blocks of about
    ``block_rows`` rows; every d block meets every q block through an
    equi-join on the q block id.  The q side is broadcast only when its
    measured size is under ``broadcast_bytes``."""
    spark = q.sparkSession
    nq, nd = q.count(), d.count()
    dim = len(q.select(vec_col).first()[0]) if nq else 0
    par = spark.sparkContext.defaultParallelism
    nbq = max(1, math.ceil(nq / block_rows))
    nbd = max(par, math.ceil(nd / block_rows)) if nd else 1
    qb = _blocks(q, q_id, vec_col, nbq, "q")
    db = _blocks(d, d_id, vec_col, nbd, "d")
    if nq * max(dim, 1) * 8 <= broadcast_bytes:
        # measured bound: the whole query side fits the broadcast limit
        pairs = db.withColumn("qblk", F.explode(F.sequence(F.lit(0), F.lit(nbq - 1)))).join(F.broadcast(qb), "qblk")
    else:
        pairs = (db.withColumn("qblk", F.explode(F.sequence(F.lit(0), F.lit(nbq - 1)))).join(qb, "qblk")
                 .repartition(nbq * nbd, "qblk", "dblk"))
    return pairs.select("qrows", "drows")


def _unpack(qr, dr):
    """Block structs → (ids, ids, Q, D) as NumPy arrays."""
    qid = np.asarray(qr["ids"], dtype=np.int64)
    did = np.asarray(dr["ids"], dtype=np.int64)
    if len(qid) == 0 or len(did) == 0:
        return qid, did, None, None
    Q = np.asarray(qr["vals"], dtype=np.float64).reshape(len(qid), -1)
    D = np.asarray(dr["vals"], dtype=np.float64).reshape(len(did), -1)
    return qid, did, Q, D


def dense_logsumexp(q: DataFrame, d: DataFrame, q_id: str, d_id: str, vec_col: str, scale: float = 1.0,
                    block_rows: int = 2048) -> DataFrame:
    """(qid, lse) with lse = log Σ_j exp(scale · q_i·d_j) over all rows of d —
    each block pair emits a max-shifted partial (m, s); partials merge per
    query as M + log Σ s·exp(m − M)."""
    def fn(it):
        for pdf in it:
            out = []
            for qr, dr in zip(pdf["qrows"], pdf["drows"]):
                qid, did, Q, D = _unpack(qr, dr)
                if Q is None or D is None:
                    continue
                sim = (Q @ D.T) * scale
                m = sim.max(axis=1)
                s = np.exp(sim - m[:, None]).sum(axis=1)
                out.append(pd.DataFrame({"qid": qid, "m": m, "s": s}))
            yield pd.concat(out, ignore_index=True) if out else pd.DataFrame(
                {"qid": pd.Series([], dtype="int64"), "m": pd.Series([], dtype="float64"),
                 "s": pd.Series([], dtype="float64")})
    parts = block_pairs(q, d, q_id, d_id, vec_col, block_rows).mapInPandas(fn, "qid long, m double, s double")
    g = parts.groupBy("qid").agg(F.max("m").alias("M"), F.collect_list(F.struct("m", "s")).alias("ps"))
    tot = F.aggregate("ps", F.lit(0.0), lambda acc, x: acc + x["s"] * F.exp(x["m"] - F.col("M")))
    return g.select("qid", (F.col("M") + F.log(tot)).alias("lse"))


# ---------------------------------------------------------------- D14 / D15


def attach(big: DataFrame, small: DataFrame, key: str, salts: int = 8) -> DataFrame:
    """Join per-key rows of ``small`` (one row per key) onto ``big`` with the
    key salted: big rows spread over ``salts`` sub-keys, small rows are
    replicated to each, so a key holding a third of ``big`` is split over
    ``salts`` tasks instead of one."""
    b = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts)))
    sm = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return b.join(sm, [key, "__salt"]).drop("__salt")


#: Points of an entity up to which one window may hold them.
ENTITY_POINTS = 100_000


def usr_descriptor(points: DataFrame, entity: str, pid: str, xyz: Sequence[str]) -> DataFrame:
    """9 moments per point cloud — mean, population std and skewness
    (m3 / (std³ + 1e-9)) of the distances to the centroid, to the point
    farthest from it, and to the point farthest from that one (ties: the
    smaller point id).  Points are shuffled once, by entity, and all moments
    are windows over it.  Entities of more than ``ENTITY_POINTS`` points
    go apart: their statistics are partial aggregates (pre-aggregated
    map-side) attached back to the points by a salted join."""
    x, y, z = (F.col(c).cast("double") for c in xyz)
    p = points.select(entity, pid, x.alias("x"), y.alias("y"), z.alias("z"))
    # at most one row for every ENTITY_POINTS points
    hot = cut_lineage(p.groupBy(entity).agg(F.count("*").alias("n")).where(F.col("n") > ENTITY_POINTS).select(entity))
    if hot.isEmpty():
        return _usr(p, entity, pid, _over)
    one = _usr(p.join(F.broadcast(hot), entity, "left_anti"), entity, pid, _over)
    return one.unionByName(_usr(p.join(F.broadcast(hot), entity, "left_semi"), entity, pid, _attached))


def _over(p: DataFrame, entity: str, **stats: Column) -> DataFrame:
    w = Window.partitionBy(entity)
    return p.where(F.col(entity).isNotNull()).select("*", *[v.over(w).alias(k) for k, v in stats.items()])


def _attached(p: DataFrame, entity: str, **stats: Column) -> DataFrame:
    return attach(p, p.groupBy(entity).agg(*[v.alias(k) for k, v in stats.items()]), entity)


def _usr(p: DataFrame, entity: str, pid: str, add) -> DataFrame:
    """``add`` gives each point statistics of its entity."""
    def dist(c):
        return F.sqrt((F.col("x") - c["x"]) ** 2 + (F.col("y") - c["y"]) ** 2 + (F.col("z") - c["z"]) ** 2)

    def farthest(d):
        return F.max_by(F.struct("x", "y", "z"), F.struct(F.col(d), (-F.col(pid)).alias("o")))

    p = add(p, entity, cx=F.avg("x"), cy=F.avg("y"), cz=F.avg("z"))
    p = p.withColumn("d1", dist({v: F.col(f"c{v}") for v in "xyz"})).drop("cx", "cy", "cz")
    for near, d in (("d1", "d2"), ("d2", "d3")):
        p = add(p, entity, f=farthest(near)).withColumn(d, dist(F.col("f"))).drop("f")
    p = add(p.drop("x", "y", "z"), entity, **{f"m_{d}": F.avg(d) for d in ("d1", "d2", "d3")})
    aggs = []
    for d in ("d1", "d2", "d3"):
        dev = F.col(d) - F.col(f"m_{d}")
        aggs += [F.first(f"m_{d}").alias(f"{d}_mean"), F.sqrt(F.avg(dev * dev)).alias(f"{d}_std"),
                 F.avg(dev * dev * dev).alias(f"{d}_m3")]
    g = p.groupBy(entity).agg(*aggs)
    names = []
    for d in ("d1", "d2", "d3"):
        g = g.withColumn(f"{d}_skew", F.col(f"{d}_m3") / (F.pow(f"{d}_std", 3) + F.lit(1e-9)))
        names += [f"{d}_mean", f"{d}_std", f"{d}_skew"]
    return g.select(entity, F.array(*[F.col(n) for n in names]).alias("usr"))


def usr_search(query: DataFrame, db: DataFrame, entity: str, k: int = 5) -> DataFrame:
    """Similarity 1/(1 + L1/12) of the query descriptor to every entity, best k."""
    q = query.orderBy(entity).first()
    q_usr = F.array(*[F.lit(float(v)) for v in q["usr"]])
    j = db.withColumn("query_id", F.lit(q[entity]))
    l1 = F.aggregate(F.zip_with("usr", q_usr, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, v: s + v)
    j = j.withColumn("distance", l1).withColumn("similarity", F.lit(1.0) / (F.lit(1.0) + F.col("distance") / 12))
    return j.orderBy(F.col("similarity").desc(), F.col(entity)).limit(k).select(
        "query_id", F.col(entity).alias("hit_id"), "distance", "similarity")


PHARM_TYPES = ["donor", "acceptor", "hydrophobic", "aromatic", "positive", "negative"]


def typed_profile(points: DataFrame, entity: str, pid: str, type_col: str, xyz: Sequence[str],
                  types: Sequence[str] = PHARM_TYPES, n_bits: int = 256, n_dist: int = 50) -> DataFrame:
    """D15 profile vector: for type i, slots 10i..10i+9 hold min(count, 10);
    slot 60+m holds int(d/2) mod 10 of the m-th upper-triangle pair distance
    (points in id order, row-major), first ``n_dist`` pairs."""
    x, y, z = xyz
    counts = points.groupBy(entity).agg(F.array(*[
        F.least(F.count_if(F.col(type_col) == F.lit(t)), F.lit(10)).cast("int") for t in types]).alias("counts"))
    # point order: id, then coordinates (ids need not be unique)
    w = Window.partitionBy(entity).orderBy(pid, "x", "y", "z")
    base = points.select(entity, pid, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"),
                         F.col(z).cast("double").alias("z"))
    # the first n_dist pairs are of the first n_dist + 1 points: the constant bound
    # lets Spark cut every group before the shuffle (group limit)
    first = base.withColumn("i", F.row_number().over(w)).where(F.col("i") <= n_dist + 1)
    first = first.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y", "z"))).alias("ps"))

    def value(a: Column, b: Column) -> Column:
        d = F.sqrt((a["x"] - b["x"]) ** 2 + (a["y"] - b["y"]) ** 2 + (a["z"] - b["z"]) ** 2)
        return F.coalesce(F.pmod(F.floor(d / 2), F.lit(10)).cast("int"), F.lit(0))

    pairs = F.flatten(F.transform("ps", lambda a: F.transform(F.slice("ps", a["i"] + 1, n_dist), lambda b: value(a, b))))
    # counts of a seventh type and on take the slots of the first pairs
    over = max(0, 10 * len(types) - 60)
    first = first.select(entity, F.slice(F.slice(pairs, 1, n_dist), over + 1, n_dist).alias("vals"))
    slots = F.concat(F.flatten(F.transform("counts", lambda c: F.array_repeat(c, 10))),
                     F.array_repeat(F.lit(0), max(0, 60 - 10 * len(types))),
                     F.coalesce("vals", F.array().cast("array<int>")), F.array_repeat(F.lit(0), n_bits))
    return counts.join(first, entity, "left").select(entity, F.slice(slots, 1, n_bits).alias("profile"))


# ---------------------------------------------------------------- D16


#: Cells of the move table that are held at once.
_CELLS = 1 << 25


def _codes(texts: Sequence[str], width: int, pad: int) -> np.ndarray:
    out = np.full((len(texts), width), pad, np.int32)
    for i, t in enumerate(texts):
        out[i, :len(t)] = np.frombuffer(t.encode("utf-32-le"), np.int32)
    return out


def align_batch(a: Sequence[str], b: Sequence[str], match: int = 1, mismatch: int = -1, gap: int = -2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Needleman–Wunsch score, identity = matches / alignment length, and length of
    pairs of texts, all pairs at once: the table is filled by anti-diagonals over
    the padded batch, the moves are kept in a byte each (diagonal before up before
    left), and all paths are walked back together."""
    n, m = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    rows, width, height = np.arange(len(a)), int(n.max(initial=0)), int(m.max(initial=0))
    x, y = _codes(a, width, -1), _codes(b, height, -2)
    moves = np.zeros((len(a), width + 1, height + 1), np.uint8)
    score = np.zeros(len(a), np.int64)
    before, last = None, np.zeros((len(a), 1), np.int64)  # diagonals d - 2 and d - 1
    lo_before = lo_last = 0
    score[n + m == 0] = 0
    for d in range(1, width + height + 1):
        lo, hi = max(0, d - height), min(width, d)
        i = np.arange(lo, hi + 1)
        now = np.full((len(a), len(i)), np.iinfo(np.int64).min // 2)
        move = np.zeros((len(a), len(i)), np.uint8)
        left = i - lo_last  # cell (i, d - 1 - i)
        ok = (left >= 0) & (left < last.shape[1]) & (i <= d - 1)
        now[:, ok] = last[:, left[ok]] + gap
        move[:, ok] = 3
        up = i - 1 - lo_last  # cell (i - 1, d - i)
        ok = (up >= 0) & (up < last.shape[1])
        value = last[:, up[ok]] + gap
        better = value >= now[:, ok]
        now[:, ok] = np.where(better, value, now[:, ok])
        move[:, ok] = np.where(better, 2, move[:, ok])
        inner = (i >= 1) & (d - i >= 1)
        if inner.any():
            at, j = i[inner], d - i[inner]
            same = x[:, at - 1] == y[:, j - 1]
            value = before[:, at - 1 - lo_before] + np.where(same, match, mismatch)
            better = value >= now[:, inner]
            now[:, inner] = np.where(better, value, now[:, inner])
            move[:, inner] = np.where(better, np.where(same, 1, 4), move[:, inner])
        moves[:, i, d - i] = move
        done = n + m == d
        score[done] = now[done, n[done] - lo]
        before, lo_before, last, lo_last = last, lo_last, now, lo
    matches, length = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    i, j = n.copy(), m.copy()
    while (todo := (i > 0) | (j > 0)).any():
        step = moves[rows, i, j]
        matches += todo & (step == 1)
        length += todo
        i -= todo & np.isin(step, (1, 2, 4))
        j -= todo & np.isin(step, (1, 3, 4))
    return score, np.where(length > 0, matches / np.maximum(length, 1), 0.0), length


def global_alignment(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -2) -> tuple[int, float, int]:
    """``align_batch`` of one pair."""
    s, i, n = align_batch([a], [b], match, mismatch, gap)
    return int(s[0]), float(i[0]), int(n[0])


def alignment_udf(match: int = 1, mismatch: int = -1, gap: int = -2):
    """Arrow-batched scorer for candidate pairs (the pairs come from a Spark
    join).  Pairs of like sizes are aligned together, as many as _CELLS allow."""
    schema = T.StructType([T.StructField("score", T.LongType()), T.StructField("identity", T.DoubleType()),
                           T.StructField("length", T.LongType())])

    @F.pandas_udf(schema)
    def align(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        a, b = a.fillna("").to_numpy(), b.fillna("").to_numpy()
        size = [(len(x) + 1, len(y) + 1) for x, y in zip(a, b)]
        order = sorted(range(len(a)), key=lambda k: size[k])
        out = np.zeros((len(a), 3))
        while order:
            k, w, h = 0, 0, 0
            while k < len(order):
                w2, h2 = max(w, size[order[k]][0]), max(h, size[order[k]][1])
                if k and (k + 1) * w2 * h2 > _CELLS:
                    break
                w, h, k = w2, h2, k + 1
            part, order = order[:k], order[k:]
            out[part] = np.column_stack(align_batch(a[part], b[part], match, mismatch, gap))
        return pd.DataFrame({"score": out[:, 0].astype(np.int64), "identity": out[:, 1], "length": out[:, 2].astype(np.int64)})
    return align


def rounded(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: r6(F.col(c)) for c in cols})
