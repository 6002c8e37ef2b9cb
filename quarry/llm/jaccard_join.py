"""Operator 10: n-gram Jaccard self-join by rare-first prefix filtering.

Texts with equal sets are one node.  Shingles are ordered rare first; two sets
of the wanted similarity share one of their first n - ceil(t n) + 1 shingles.
Such prefix shingles are shuffled once.  In each group of a shingle, every node
is first held against one hub of about its size, so that a large group of near
copies costs a link each; what is linked is a component.  Sets that are not in
a group's main component are then held against some of its members.  Last, all pairs of *different*
components that share a prefix shingle and pass the length, positional and
suffix filters (within the join by sketches of the sets' parts, then by the
parts) are verified, each once.  Pairs inside a component need no test:
no link between components can be missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bucketed, materialize, row_key, scratch, short_batches, slices
from .jaccard_sets import PARTS, parts, shingle_sets, signature, sketches

#: Shingles in the table that orders them, at most.
FREQUENT = 1 << 21
#: Shingles that a task counts at once, and the least count that it reports.
COUNTED, REPORTED = 4_000_000, 2
#: Sets that a task remembers, not to send a copy's prefix again.
SEEN = 1_000_000
#: Turns in which sets are held against large components that they meet, and
#: the members that one set is held against in a turn.
PROBES, PARTNERS = 2, 8
#: Columns of a set's sketch.
SKETCH = [f"h{i}" for i in range(PARTS // 32)]


def _scan(src: DataFrame, size: int) -> DataFrame:
    """One pass: a row per text (its set's signature, size and parts) and a
    row per shingle that is frequent in a stretch of the scan."""
    kind = src.schema["id"].dataType.simpleString()

    def run(it):
        held, many = [], 0

        def counted():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            u, c = u[c >= REPORTED], c[c >= REPORTED]
            return pa.RecordBatch.from_arrays(
                [pa.nulls(len(u), pa.int64()), pa.nulls(len(u), pa.int64()), pa.nulls(len(u), id_type),
                 pa.array(u.view(np.int64)), pa.array(c.astype(np.int64)), pa.nulls(len(u), pa.binary())], names)

        names = ["__k1", "__k2", "id", "s", "n", "q"]
        for b in slices(it):
            id_type = b.schema.field(2).type
            s, n, q = [], [], []
            for x in shingle_sets(b.column(3).to_pylist(), size):
                held.append(x)
                many += len(x)
                s.append(signature(x))
                n.append(len(x))
                q.append(parts(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(s, pa.int64()),
                                              pa.array(n, pa.int64()), pa.array(q, pa.binary())], names)
            if many > COUNTED:
                yield counted()
                held, many = [], 0
        if many:
            yield counted()

    return src.mapInArrow(run, f"__k1 bigint, __k2 bigint, id {kind}, s bigint, n bigint, q binary")


def _frequent(scan: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their counts: all that were reported, or
    if these are more than FREQUENT, those above the least count that leaves so
    many.  A count may lack occurrences in stretches where the shingle is rare,
    which shifts the order but keeps it one order for all sets, as the join
    needs."""
    counts = materialize(scan.where("q is null").groupBy("s").agg(F.sum("n").alias("n")), "frequent")
    left, least = FREQUENT, 0
    for r in sorted(counts.groupBy("n").agg(F.count("*").alias("k")).collect(), key=lambda r: -r["n"]):
        left -= r["k"]
        if left < 0:
            least = r["n"] + 1
            break
    t = counts.where(F.col("n") >= least).toArrow()
    known = t.column(0).to_numpy().view(np.uint64)
    order = np.argsort(known)
    return known[order], t.column(1).to_numpy()[order]


def _prefixes(src: DataFrame, size: int, percent: int, frequent) -> DataFrame:
    """(t, s, n, p): prefix shingle, set, its size, place in rare-first order."""
    bc = src.sparkSession.sparkContext.broadcast(frequent)

    def run(it):
        known, counts = bc.value
        seen: set[int] = set()
        for b in slices(it):
            cols: list[list] = [[], [], [], []]
            for x in shingle_sets(b.column(0).to_pylist(), size):
                n = len(x)
                if not n:
                    continue
                s = signature(x)
                if s in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(s)
                m = n - -(-percent * n // 100) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, x), len(known) - 1)
                    df = np.where(known[at] == x, counts[at], 0)
                    x = x[np.lexsort((x, df))[:m]]
                else:
                    x = x[:m]
                cols[0].append(x.view(np.int64))
                cols[1].append(np.full(m, s, np.int64))
                cols[2].append(np.full(m, n, np.int32))
                cols[3].append(np.arange(m, dtype=np.int32))
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["t", "s", "n", "p"])

    return src.select("t").mapInArrow(run, "t bigint, s bigint, n int, p int")


def _shared(prefixes: DataFrame, percent: int) -> DataFrame:
    """Prefix rows whose shingle another set of a size that may link has, with
    the hub of the row's size class: the smallest set of that class.  Rows come
    sorted by shingle, size and set, so a group streams through, however long."""
    ratio = math.log(200 / (100 + percent))

    def run(it):
        last = None  # the row before, whether it is out already, and its hub
        for b in it:
            t, s, n, p = (b.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if last is not None:
                row, out, hub = last
                t, s, n, p = (np.concatenate([[r], x]).astype(x.dtype) for r, x in zip(row, (t, s, n, p), strict=True))
            else:
                out, hub = False, None
            new = np.ones(len(t), bool)  # repeated rows go
            new[1:] = (t[1:] != t[:-1]) | (s[1:] != s[:-1])
            t, s, n, p = t[new], s[new], n[new], p[new]
            level = np.floor(np.log(n) / ratio).astype(np.int64)
            head = np.ones(len(t), bool)
            head[1:] = (t[1:] != t[:-1]) | (level[1:] != level[:-1])
            first = np.maximum.accumulate(np.where(head, np.arange(len(t)), 0))
            hs, hn, hp = s[first], n[first], p[first]
            if hub is not None:
                same = first == 0
                hs[same], hn[same], hp[same] = hub
            pair = (t[1:] == t[:-1]) & (100 * n[:-1].astype(np.int64) >= percent * n[1:].astype(np.int64))
            mates = np.zeros(len(t), bool)
            mates[1:] = pair
            mates[:-1] |= pair
            mates[0] |= out
            k = len(t) - 1
            keep = mates.copy()
            keep[0] &= not out  # sent with the batch before
            last = ((t[k], s[k], n[k], p[k]), bool(mates[k]), (hs[k], hn[k], hp[k]))
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (t, s, n, p, hs, hn, hp)],
                                                 ["t", "s", "n", "p", "hs", "hn", "hp"])

    return (prefixes.repartition("t").sortWithinPartitions("t", "n", "s")
            .mapInArrow(run, "t bigint, s bigint, n int, p int, hs bigint, hn int, hp int"))


def _may_link(percent: int, n: Column, p: Column, m: Column, q: Column) -> Column:
    """Length and positional filters: with this shingle at places p and q, at
    most 1 + what is left after them is common."""
    most = F.lit(1) + F.least(n - p - 1, m - q - 1)
    return ((F.least(n, m) * 100 >= F.greatest(n, m) * percent)
            & (most * (100 + percent) >= (n + m) * percent))


def _sketched(classes: DataFrame) -> DataFrame:
    """(s, SKETCH): the sketch of each set's parts."""

    def run(it):
        for b in it:
            q = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, PARTS)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, sketches(q).T)], ["s", *SKETCH])

    return classes.select("s", "q").mapInArrow(run, "s bigint, " + ", ".join(f"{h} bigint" for h in SKETCH))


def _alike(percent: int) -> Column:
    """The suffix filter on sketches: sets that link differ in no more bits than shingles."""
    apart = sum((F.bit_count(F.col(h).bitwiseXOR(F.col(f"{h}_2"))) for h in SKETCH), F.lit(0))
    return apart * (100 + percent) <= (F.col("n") + F.col("m")) * (100 - percent)


def _suffix_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose sets' parts by fixed pivots are alike enough: sets
    that link differ in at most (100 - percent) / (100 + percent) of their sizes."""

    def run(it):
        for b in it:
            n, m = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 3))
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, PARTS).astype(np.int16) for i in (4, 5))
            apart = np.abs(x - y).sum(axis=1, dtype=np.int64)
            keep = pa.array(apart * (100 + percent) <= (n + m) * (100 - percent))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    c = classes.select("s", "n", "q")
    return (pairs.join(c.toDF("u", "n", "x"), "u").join(c.toDF("v", "m", "y"), "v").select("u", "v", "n", "m", "x", "y")
            .mapInArrow(run, "u bigint, v bigint"))


def _verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, tried: list[DataFrame]) -> DataFrame:
    """Pairs (u, v) that link, by the sets of their nodes' texts.  Pairs in
    ``tried`` are left out, and those of this call are added to it."""
    for old in tried:
        pairs = pairs.join(old, ["u", "v"], "left_anti")
    pairs = materialize(_suffix_filter(pairs, classes, percent), "pairs")
    tried.append(pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    need = pairs.select(F.col("u").alias("s")).union(pairs.select("v")).distinct()
    need = classes.select("s", "f.__k1", "f.__k2").join(need, "s", "left_semi").drop("s")
    texts = materialize(texts.join(need, ["__k1", "__k2"], "left_semi").select("s", "t"), "pair-texts")

    def run(it):
        for b in slices(it):
            left, right = (shingle_sets(b.column(i).to_pylist(), size) for i in (2, 3))
            ok = []
            for x, y in zip(left, right, strict=True):
                common = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * common >= percent * (len(x) + len(y) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    with short_batches(pairs.sparkSession):
        return materialize(pairs.join(texts.toDF("u", "x"), "u").join(texts.toDF("v", "y"), "v").select("u", "v", "x", "y")
                           .mapInArrow(run, "u bigint, v bigint"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component of ``edges`` (u, v).

    Labels spread to neighbours and jump to their label's label until none
    changes; every round is a written table."""
    both = materialize(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    label = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m"))
                        .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = (both.join(label.toDF("v", "m"), "v").groupBy(F.col("u").alias("node")).agg(F.min("m").alias("m")))
        step = label.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = materialize(step.join(jump, "label").select("node", F.least("label", "far").alias("label"),
                                                          (F.least("label", "far") != F.col("old")).alias("moved")), "labels")
        label = new.select("node", "label")
        if new.where("moved").isEmpty():
            return label


def link_classes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (__k1, __k2, id, s, n) and classes (s, label) of nodes that link
    with another; nodes without a label link with none."""
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    src = docs.select(k1, k2, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    with scratch(docs.sparkSession, "sets", "classes-of-sets"):
        with short_batches(docs.sparkSession):
            scan = materialize(_scan(src, size), "sets")
        rows = scan.where("q is not null")
        return rows, materialize(_classes(src, scan, size, percent), "classes-of-sets")


def _classes(src: DataFrame, scan: DataFrame, size: int, percent: int) -> DataFrame:
    rows = scan.where("q is not null")
    classes = materialize(rows.where("n > 0").groupBy("s").agg(
        F.min(F.struct("__k1", "__k2")).alias("f"), F.first("n").cast("int").alias("n"), F.first("q").alias("q")), "classes")
    shared = materialize(_shared(_prefixes(src, size, percent, _frequent(scan)), percent), "shared")
    # The texts of all nodes that may link, fetched once.
    nodes = classes.select("s", "f.__k1", "f.__k2").join(shared.select("s").distinct(), "s", "left_semi")
    texts = bucketed(src.select("__k1", "__k2", "t").join(nodes, ["__k1", "__k2"]).dropDuplicates(["__k1", "__k2"]),
                     ["__k1", "__k2"], "node_texts")
    c = F.col
    stars = (shared.where(c("s") != c("hs")).where(_may_link(percent, c("n"), c("p"), c("hn"), c("hp")))
             .select(c("s").alias("u"), c("hs").alias("v")).distinct())
    tried: list[DataFrame] = []
    links = _verify(stars, classes, texts, size, percent, tried)
    for turn in range(PROBES):
        links = links.union(_verify(_probes(_mixed(shared, links), percent, turn), classes, texts, size, percent, tried))
    # All that is left: pairs of different components.
    x = materialize(_mixed(shared, links).join(_sketched(classes), "s"), "sketched")
    y = x.select("t", c("s").alias("v"), c("n").alias("m"), c("p").alias("p2"), c("c").alias("c2"), *[c(h).alias(f"{h}_2") for h in SKETCH])
    pairs = (x.join(y, "t").where((c("c") != c("c2")) & ((c("n") < c("m")) | ((c("n") == c("m")) & (c("s") < c("v"))))
                                  & _may_link(percent, c("n"), c("p"), c("m"), c("p2")) & _alike(percent))
             .select(c("s").alias("u"), "v").distinct())
    return components(links.union(_verify(pairs, classes, texts, size, percent, tried)))


def _probes(mixed: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs (u, v): each set against members of the components that most rows
    of its shingles' groups are in, other members in every group and turn.
    PARTNERS of a set are tried now; the rest is left to the last step."""
    level = F.floor(F.log("n") / math.log(200 / (100 + percent)))
    rows = mixed.withColumn("level", level)
    main = (rows.groupBy("t", "level", "c").agg(
                F.count("*").alias("k"), F.min_by(F.struct("n", "s", "p"), F.xxhash64("s", "t", F.lit(turn))).alias("h"))
            .groupBy("t", "level").agg(F.max(F.struct("k", "c", "h")).alias("m")))
    col = F.col
    pairs = (rows.join(main, ["t", "level"]).where(col("c") != col("m.c"))
             .where(_may_link(percent, col("n"), col("p"), col("m.h.n"), col("m.h.p")))
             .select(col("s").alias("u"), col("m.h.s").alias("v")).distinct())
    w = Window.partitionBy("u").orderBy(F.xxhash64("u", "v"), "v")
    return pairs.withColumn("r", F.row_number().over(w)).where(col("r") <= PARTNERS).select("u", "v")


def _mixed(shared: DataFrame, links: DataFrame) -> DataFrame:
    """Prefix rows (t, s, n, p, c) of shingles that several components have."""
    label = components(links).withColumnRenamed("node", "s")
    placed = materialize(shared.select("t", "s", "n", "p").join(label, "s", "left")
                         .select("t", "s", "n", "p", F.coalesce("label", "s").alias("c")), "placed")
    mixed = placed.groupBy("t").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a <> b").select("t")
    return materialize(placed.join(mixed, "t", "left_semi"), "mixed")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4,
                       percent: int = 85) -> DataFrame:
    """Per document: ``id_col``, n_shingles, component_id (the smallest id that
    links reach).  Two documents link when 100 * common >= percent * union of
    their distinct shingles of ``size`` words.

    A text of fewer words is one shingle; null, empty and wordless texts have
    none, link with nothing and keep their own id.  Null ids count for no
    minimum (a component of null ids only has a null id).  Repeated rows link
    with each other.  An empty table gives no rows; other columns are not read."""
    rows, label = link_classes(docs, id_col, text_col, size, percent)
    node = rows.join(label.withColumnRenamed("node", "s"), "s", "left").select(
        "id", "n", F.when(F.col("n") > 0, F.coalesce("label", "s")).alias("c"))
    low = node.where("c is not null").groupBy("c").agg(F.min("id").alias("low"))
    return node.join(low, "c", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("low")).otherwise(F.col("id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                percent: int = 80) -> DataFrame:
    """All columns of one document of each component, that with the smallest id
    (a null id last); texts without words all stay.  Ties and nulls as in
    ``jaccard_components``; a row repeated in id and text stays once."""
    rows, label = link_classes(docs, id_col, text_col, size, percent)
    keys = ["__k1", "__k2"]
    node = rows.where("n > 0").join(label.withColumnRenamed("node", "s"), "s", "left")
    pick = (node.groupBy(F.coalesce("label", "s").alias("c"))
            .agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", *keys)).alias("f")).select("f.__k1", "f.__k2"))
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), k1, k2)
    bare = rows.where("n = 0").select(*keys).distinct()
    one = wide.join(pick, keys, "left_semi").dropDuplicates(keys)
    return one.unionByName(wide.join(bare, keys, "left_semi")).select("row.*")
