"""Operator 6: benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, slices

#: Bytes of benchmark text in one block; a block's windows are broadcast.
BLOCK_BYTES = 16 << 20

#: A-Z to a-z, every byte that is in no word to a space.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def words(text: str) -> list[bytes]:
    """Words [0-9a-z and code points from 128 on] of the lower-cased text."""
    return text.encode().translate(_TABLE).split()


def item_windows(items: list[tuple[str, str]], size: int) -> dict[bytes, set[str]]:
    """Windows of ``size`` words (a shorter item is one window) and their items."""
    out: dict[bytes, set[str]] = defaultdict(set)
    for item, text in items:
        w = words(text)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            out[b" ".join(w[s:s + size])].add(item)
    return dict(out)


def prefix_index(windows: dict[bytes, set[str]], df: dict[bytes, int]) -> dict[bytes, list[tuple[int, int]]]:
    """Rarest word of each window -> (its offset, words of the window).

    A window occurs only where all its words do, so the prefix that an exact
    containment needs is its one rarest word; a window with a word that no
    document has is left out."""
    found: dict[bytes, set[tuple[int, int]]] = defaultdict(set)
    for key in windows:
        w = key.split(b" ")
        n, _, off = min((df.get(x, 0), x, i) for i, x in enumerate(w))
        if n:
            found[w[off]].add((off, len(w)))
    return {k: sorted(v) for k, v in found.items()}


def hits(w: list[bytes], windows: dict[bytes, set[str]], prefix: dict[bytes, list[tuple[int, int]]],
         rare: frozenset[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged word spans that windows cover, and the items they are of."""
    if rare.isdisjoint(w):
        return [], set()
    spans, items, n = set(), set(), len(w)
    for i, x in enumerate(w):
        if x in rare:
            for off, size in prefix[x]:
                s = i - off
                if s >= 0 and s + size <= n and (s, s + size) not in spans:
                    got = windows.get(b" ".join(w[s:s + size]))
                    if got:
                        spans.add((s, s + size))
                        items |= got
    return merge(spans), items


def merge(spans) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def document_frequency(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """Documents that have each word of a bounded vocabulary; counted over all."""
    bc = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(it):
        seen: Counter = Counter()
        vocab = bc.value
        for b in slices(it):
            for t in b.column(0).to_pylist():
                seen.update(vocab.intersection(words(t)))
        yield pa.RecordBatch.from_pydict({"w": pa.array(list(seen), pa.binary()),
                                          "n": pa.array(list(seen.values()), pa.int64())})

    rows = docs.mapInArrow(run, "w binary, n bigint").groupBy("w").agg(F.sum("n").alias("n")).collect()
    bc.unpersist()
    return {bytes(r["w"]): r["n"] for r in rows}


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", size: int = 10,
                  block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """Per document: ``id_col``, n_words, n_hit (words inside any occurring
    window), n_items, items_sha256, contaminated, items (sorted ids), and with
    ``carry`` the whole row as a struct ``row``.

    The benchmark is the query set: it is taken in blocks of about
    ``block_bytes`` so that what is broadcast has a bound, and every block is
    held against all documents.  Per block, the windows' words are counted over
    all documents, each window is indexed by its rarest word, documents are
    probed for these words, and a window that fits in the document at that
    place is verified word for word.

    Null and empty texts have no words; a null item id is listed as an empty
    string, an item without words matches nothing; repeated rows each give a
    row; with an empty benchmark nothing is hit; other columns are not read."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    k1, k2 = row_key(F.col(id_col), F.col(text_col))
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    src = docs.select(k1, k2, F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"),
                      *([row] if carry else []))
    extra = f", row {src.schema['row'].dataType.simpleString()}" if carry else ""
    bench = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"),
                             F.col(item_text_col).alias("t")).where("t is not null")
    total = bench.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    parts = []
    for k in range(blocks):
        items = [(r["i"], r["t"]) for r in bench.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).collect()]
        windows = item_windows(items, size)
        df = document_frequency(src.select("t"), frozenset(x for key in windows for x in key.split(b" "))) if windows else {}
        prefix = prefix_index(windows, df)
        bc = spark.sparkContext.broadcast((windows, prefix, frozenset(prefix)))

        def run(it, bc=bc):
            windows, prefix, rare = bc.value
            for b in slices(it):
                n, spans, found = [], [], []
                for t in b.column(3).to_pylist():
                    w = words(t)
                    s, i = hits(w, windows, prefix, rare)
                    n.append(len(w))
                    spans.append([x for p in s for x in p])
                    found.append(sorted(i))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), b.column(2), pa.array(n, pa.int64()),
                     pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
                    + ([b.column(4)] if carry else []),
                    ["__k1", "__k2", "id", "n_words", "spans", "items"] + (["row"] if carry else []))

        parts.append(src.mapInArrow(run, f"__k1 bigint, __k2 bigint, id {kind}, n_words bigint, spans array<int>, "
                                         "items array<string>" + extra))
    out = parts[0]
    if blocks > 1:
        out = _combine(parts)
    return out.select(
        F.col("id").alias(id_col), "n_words",
        F.expr("aggregate(transform(spans, (x, i) -> if(i % 2 = 1, x, -x)), 0L, (a, x) -> a + x)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"), "items", *(["row"] if carry else []))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """All columns of the documents that no benchmark window hits."""
    return decontaminate(docs, benchmark, carry=True, **options).where("not contaminated").select("row.*")


def _combine(parts: list[DataFrame]) -> DataFrame:
    """Spans and items of the blocks, merged per row; copies of a row keep their number."""
    keys = ["__k1", "__k2"]
    rest = []
    for k, p in enumerate(parts):
        found = p.where(F.size("spans") > 0).select(*keys, "spans", "items").dropDuplicates(keys)
        rest.append(found.withColumn("block", F.lit(k)))
    joined = rest[0]
    for r in rest[1:]:
        joined = joined.unionByName(r)

    @F.pandas_udf("array<int>")
    def merged(col):
        return col.map(lambda rows: [x for p in merge({(r[i], r[i + 1]) for r in rows for i in range(0, len(r), 2)})
                                     for x in p])

    agg = joined.groupBy(*keys).agg(F.collect_list("spans").alias("s"), F.flatten(F.collect_list("items")).alias("i"))
    agg = agg.select(*keys, merged("s").alias("spans"), F.array_sort(F.array_distinct("i")).alias("items"))
    base = parts[0].drop("spans", "items")
    return (base.join(agg, keys, "left")
            .withColumn("spans", F.coalesce("spans", F.array().cast("array<int>")))
            .withColumn("items", F.coalesce("items", F.array().cast("array<string>"))))
