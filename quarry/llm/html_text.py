"""Operator 2: main text of pages, with a suffix array of each host.

Markup is cut into blocks with the role of the element that holds them.  What
stands in an article container is the page's text, less menus, notices, forms,
adverts and comments in it; else what stands outside of such parts; else all.
This text is judged by a suffix array: the streams of a host's pages, a 64-bit
hash per block, are concatenated and sorted by suffix; a run of whole blocks that a share of the
host's pages has, anywhere on them, is boilerplate and cut.  Pages that are near
copies of each other (connected by equal bands of MinHash values of their text)
count as one.

A host's pages are dealt to chunks of bounded size, each sorted by one task;
windows of a host with several chunks are then counted by hash, so that a hot
host is whole without being gathered.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, slices
from .suffix_dedup import mix, prefix_hash, span_hash, suffix_sort

#: Least tokens of a run of whole blocks that is judged.
RUN = 6
#: Least share of a host's pages, and least number, that make a run of theirs
#: boilerplate; near copies are one page.  Two pages may quote each other.
SHARE, PAGES = 0.1, 3
#: MinHash values of 5-token windows: pages that agree in a whole band are near
#: copies (with a Jaccard similarity of 0.9 all but 1 pair in 10,000, of 0.5 6 %).
BANDS, ROWS, SHINGLE = 16, 8, 5
#: Bytes of a host's streams that one task sorts.
CHUNK = 1 << 19

# A quote opens a value only after "="; one that never closes ends with the tag,
# a tag that never closes with the page.  Possessive, so that no page is scanned twice.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<([!?])[^>]*>?|"
                  r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|[\"'][^>]*+|(?=>|\Z)))*+)(?:>|\Z)", re.S)
_RAW = frozenset("script style noscript template textarea iframe svg math object audio video canvas title select".split())
_DROP = frozenset("nav footer aside form dialog menu button".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
#: Words in class, id or role that mark parts which are no article text.
_BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|nav\w*|menu|breadcrumbs?|sidebar|widget|footer|"
                  r"masthead|site-header|page-header|cookie\w*|consent|gdpr|popup|modal|newsletter|subscribe|signup|"
                  r"social|related|recommend\w*|comments?|disqus|replies|respond|login|navigation|complementary|contentinfo|"
                  r"hidden)(?:$|[\s_-])", re.I)
#: Words that do so only as a whole class name, or with a word for a piece of
#: layout: "share-buttons" is such a part, "share-price" is not.
_BAD_NAME = re.compile(r"(?:^|\s)(?:(?:site|page|post|article|top|bottom|left|right)[_-])?(?:side|notice|alert|share|shares|sharing)"
                       r"(?:[_-](?:bar|box|block|button|buttons|col|column|container|icons?|inner|items?|left|links?|list|message|panel|right|"
                       r"tools?|widget|wide|wrap|wrapper|\d+))*(?:$|\s)", re.I)
#: The same for parts of a page that stand for themselves in an article.
_BAD_OUTSIDE = re.compile(r"(?:^|[\s_-])search(?:$|[\s_-])", re.I)
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_GOOD = re.compile(r"(?:^|[\s_-])(?:article|article-?body|post-?body|post-?content|entry-?content|main-?content|content|story|main)(?:$|[\s_-])", re.I)
_WS = re.compile(r"\s+")


@lru_cache(1 << 12)
def _role(tag: str, attrs: str) -> str:
    """'drop', 'outside' (to drop but in an article), 'article', 'header' or ''
    for an element."""
    if tag in _DROP:
        return "drop"
    good, outside = tag in ("article", "main"), False
    if attrs.strip():
        for name, *values in _ATTR.findall(attrs):
            name, value = name.lower(), html.unescape("".join(values))
            if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _UNSEEN.search(value)):
                return "drop"
            if name in ("class", "id", "role") and tag not in ("html", "body"):
                if _BAD.search(value) or _BAD_NAME.search(value):
                    return "drop"
                outside = outside or bool(_BAD_OUTSIDE.search(value))
            if name in ("class", "id", "role", "itemprop") and _GOOD.search(value) and tag in ("div", "section", "td"):
                good = True
    return "outside" if outside else "article" if good else "header" if tag == "header" else ""


def blocks(page: str) -> tuple[list[str], list[str], list[str]]:
    """Texts of blocks: in an article container, outside of one, and in parts
    that are no article text."""
    article: list[str] = []
    plain: list[str] = []
    dropped: list[str] = []
    open_: list[tuple[str, str]] = []  # elements that change the role
    names: Counter[str] = Counter()  # of these
    forms: list[int] = []  # places of forms to drop among them
    endless: set[str] = set()  # inline tags that are closed nowhere from here on
    held: list[str] = []
    deep = drop = at = 0

    def flush():
        if held:
            text = _WS.sub(" ", html.unescape("".join(held))).strip()
            held.clear()
            if text:
                (dropped if drop else article if deep else plain).append(text)

    pos, find = 0, _TAG.search
    while m := find(page, pos):
        if m.start() > at:
            held.append(page[at:m.start()])
        at = pos = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if m[2] or not m[4]:
                continue
            if tag not in endless and _role(tag, m[4]) == "drop":
                if end := re.compile(rf"</{tag}\s*>", re.I).search(page, at):
                    at = pos = end.end()
                else:
                    endless.add(tag)
            continue
        if tag in _RAW and not m[2]:
            if m[4].endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = pos = end.end() if end else len(page)
            continue
        if tag == "br":
            held.append(" ")
            continue
        flush()
        if tag in _VOID:
            continue
        if m[2]:
            if names[tag]:
                while open_:
                    t, r = open_.pop()
                    names[t] -= 1
                    if forms and forms[-1] == len(open_):
                        forms.pop()
                    deep -= r == "article"
                    drop -= r == "drop"
                    if t == tag:
                        break
        else:
            r = _role(tag, m[4])
            if r in ("header", "outside"):
                r = "" if deep else "drop"
            if r == "article" and tag in ("article", "main"):  # a form that wraps the article is no part to drop
                for i in forms:
                    open_[i] = ("form", "")
                    drop -= 1
                forms.clear()
            if r or tag in ("div", "section", "header", "td", "ul", "ol", "dl", "table"):
                if tag == "form" and r == "drop":
                    forms.append(len(open_))
                open_.append((tag, r))
                names[tag] += 1
                deep += r == "article"
                drop += r == "drop"
    if at < len(page):
        held.append(page[at:])
    flush()
    return article, plain, dropped


def parts(page: str) -> tuple[str, str]:
    """The page's text before it is judged, and the rest, blocks ended by a line
    end.  A page that has text only in parts to drop has the text of these."""
    found = [x for x in blocks(page) if x]
    return "".join(f"{x}\n" for x in found[0]) if found else "", "".join(f"{x}\n" for y in found[1:] for x in y)


_HOST = re.compile(r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _key(d: DataFrame, id_col: str, url_col: str, html_col: str) -> list:
    c = [F.col(id_col), F.col(url_col), F.col(html_col)]
    return [F.xxhash64(*c).alias("__k1"), F.xxhash64(F.lit(7), *c[::-1]).alias("__k2")]


_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def sketch(text: bytes) -> tuple[int, list[int]]:
    """Hash of a text of blocks that end in a line end, and its bands."""
    data = np.frombuffer(text, np.uint8)
    p = prefix_hash(data)
    end = np.flatnonzero((data == 32) | (data == 10))  # each ends a token
    start = np.concatenate([[0], end[:-1] + 1])
    n = max(1, len(end) - SHINGLE + 1)
    last = end[min(SHINGLE, len(end)) - 1:][:n]
    h = np.unique(mix(span_hash(p, start[:n], last) + (last - start[:n]).astype(np.uint64)))
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(h), 1 << 12):
        low = np.minimum(low, (h[i:i + (1 << 12), None] * _FACTORS).min(axis=0))
    bands = mix((mix(low) * _FACTORS).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64))
    whole = span_hash(p, np.array([0]), np.array([len(data)]))
    return int(whole.view(np.int64)[0]), bands.view(np.int64).tolist()


def block_hashes(text: bytes) -> tuple[bytes, np.ndarray]:
    """Hashes of the blocks, 8 bytes each, and their numbers of tokens."""
    data = np.frombuffer(text, np.uint8)
    line = np.flatnonzero(data == 10)
    if not len(line):
        return b"", np.zeros(0, np.int32)
    start = np.concatenate([[0], line[:-1] + 1])
    spaces = np.cumsum(data == 32)
    h = mix(span_hash(prefix_hash(data), start, line) + (line - start).astype(np.uint64))
    return h.tobytes(), (spaces[line] - spaces[start] + 1).astype(np.int32)


def _streams(pages: DataFrame, keys: list, url_col: str, html_col: str) -> DataFrame:
    """(__k1, __k2, host, stream, tokens, judged, same, bands): 8-byte hashes and
    token counts of all blocks, the page's text first, which has ``judged``
    blocks; same and bands are the sketch of the page's text."""

    def run(it):
        for b in slices(it):
            host, stream, tokens, size, same, bands = [], [], [], [], [], []
            for url, page in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                text, rest = parts(page)
                host.append(host_of(url))
                size.append(text.count("\n"))
                hashes, n = block_hashes((text + rest).encode())
                stream.append(hashes)
                tokens.append(n)
                s, k = sketch(text.encode()) if text else (0, [])
                same.append(s)
                bands.append(k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(host, pa.string()), pa.array(stream, pa.binary()), pa.array(tokens, pa.list_(pa.int32())),
                 pa.array(size, pa.int32()), pa.array(same, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                ["__k1", "__k2", "host", "stream", "tokens", "judged", "same", "bands"])

    src = pages.select(*keys, F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return src.mapInArrow(run, "__k1 bigint, __k2 bigint, host string, stream binary, tokens array<int>, judged int, "
                               "same bigint, bands array<bigint>").where("judged > 0")


def near_copies(streams: DataFrame) -> DataFrame:
    """(host, same, copy): the least hash among the pages of a host that bands
    connect with the page; pages that share none are left out."""
    # Dealt by band once: all that follows up to the edges lies as it is.
    rows = (streams.select("host", "same", F.explode("bands").alias("band"))
            .select("host", "same", F.xxhash64("host", "band").alias("band")).repartition("band").select("band", "host", "same").distinct())
    shared = rows.groupBy("band").agg(F.min("same").alias("a"), F.max("same").alias("b")).where("a <> b")
    edges = materialize(rows.join(shared.select("band"), "band", "left_semi"), "copies")
    now = edges.select("host", "same", F.col("same").alias("copy")).distinct()
    if edges.isEmpty():
        return now
    while True:
        least = edges.join(now, ["host", "same"]).groupBy("band").agg(F.min("copy").alias("copy"))
        new = materialize(edges.join(least, "band").groupBy("host", "same").agg(F.min("copy").alias("copy")), "copy")
        if new.join(now.withColumnRenamed("copy", "old"), ["host", "same"]).where("copy <> old").isEmpty():
            return new
        now = new


def repeated_windows(streams: list[bytes], run: int, tokens: np.ndarray | None = None,
                     breaks: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Windows of ``run`` tokens: page, first byte, end, a number per content,
    by a suffix array over the concatenated streams.  With ``tokens`` of each
    block, streams are 8-byte hashes of blocks, and windows the shortest runs
    of blocks with so many tokens, none across block ``breaks`` of its stream."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    ends = np.cumsum([len(s) for s in streams])
    if tokens is None:
        space = np.flatnonzero(data == 32)  # each ends a token
        start = np.concatenate([[0], space[:-1] + 1]) if len(space) else space
        page = np.searchsorted(ends, start, side="right")
        n = max(0, len(start) - run + 1)
        begin, end = start[:n], space[run - 1:]
        whole = page[:n] == page[run - 1:]
    else:
        start = np.arange(0, len(data), 8)
        page = np.searchsorted(ends, start, side="right")
        total = np.cumsum(tokens)
        last = np.searchsorted(total, total - tokens + run)
        last = last[last < len(start)]
        n = len(last)
        begin, end = start[:n], start[last] + 7
        part = start >= (ends - [len(s) for s in streams] + 8 * breaks)[page]
        whole = (page[:n] == page[last]) & (part[:n] == part[last])
    begin, end, page = begin[whole], end[whole] + 1, page[:n][whole]
    if not len(begin):
        return begin, begin, begin, begin
    order, lcp = suffix_sort(data, begin, end - begin, np.zeros(len(begin), np.int64))
    size = (end - begin)[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (lcp[1:] < size[1:]) | (size[1:] != size[:-1])
    content = np.empty(len(order), np.int64)
    content[order] = np.cumsum(fresh) - 1
    return page, begin, end, content


def boilerplate(streams: DataFrame, run: int = RUN, chunk_bytes: int = CHUNK) -> DataFrame:
    """(__k1, __k2, spans): runs (first block, end) of the judged texts, ``run``
    tokens at least, that SHARE of the host's pages have."""
    streams = materialize(streams, "streams")
    copies = near_copies(streams)
    sizes = (streams.select("host", "same", F.octet_length("stream").alias("b")).join(copies, ["host", "same"], "left")
             .groupBy("host", F.coalesce("copy", "same").alias("same")).agg(F.sum("b").alias("b"))
             .groupBy("host").agg(F.sum("b").alias("b"), F.count("*").alias("n")))
    sizes = materialize(sizes.select("host", F.ceil(F.col("b") / chunk_bytes).cast("int").alias("chunks"),
                                     F.greatest(F.lit(PAGES), F.ceil(SHARE * F.col("n"))).cast("long").alias("need")), "hosts")
    dealt = (streams.join(sizes, "host").join(copies, ["host", "same"], "left")
             .withColumn("chunk", F.pmod(F.xxhash64("__k1", "__k2"), F.col("chunks")))
             .select("host", "chunk", "chunks", "__k1", "__k2", "stream", "judged", F.coalesce("copy", "same").alias("same"), "need", "tokens"))

    def solve(rows):
        data = [r[5] for r in rows]
        first = np.cumsum([0, *map(len, data)])
        judged = np.array([r[6] for r in rows])
        page, begin, end, content = repeated_windows(data, run, np.concatenate([r[9] for r in rows]).astype(np.int64), judged)
        p = prefix_hash(np.frombuffer(b"".join(data), np.uint8))
        same = np.array([r[7] for r in rows], np.int64)
        need = rows[0][8]
        own = end <= (first[:-1] + 8 * judged)[page]
        here = rows[0][2] == 1  # no other chunk may have the window too
        if here:
            _, number = np.unique(same, return_inverse=True)
            held = np.unique(content * len(rows) + number[page]) // len(rows)
            keep = own & (np.bincount(held, minlength=len(content))[content] >= need)
        else:
            keep = np.ones(len(content), bool)
        h = mix(span_hash(p, begin, end) + (end - begin).astype(np.uint64)).view(np.int64)
        k = np.array([[r[3], r[4]] for r in rows], np.int64)[page[keep]]
        at = first[page[keep]]
        return pa.RecordBatch.from_arrays(
            [pa.array([rows[0][0]] * len(k), pa.string()), pa.array(h[keep]), pa.array([here] * len(k), pa.bool_()), pa.array(same[page[keep]]),
             pa.array([need] * len(k), pa.int64()), pa.array(k[:, 0]), pa.array(k[:, 1]),
             pa.array(((begin[keep] - at) // 8).astype(np.int32)), pa.array(((end[keep] - at) // 8).astype(np.int32)), pa.array(own[keep])],
            ["host", "h", "here", "same", "need", "__k1", "__k2", "s", "e", "own"])

    def sort(it):
        rows: list[tuple] = []
        for b in slices(it):
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and r[:2] != rows[0][:2]:
                    yield solve(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield solve(rows)

    windows = (dealt.repartition("host", "chunk").sortWithinPartitions("host", "chunk")
               .mapInArrow(sort, "host string, h bigint, here boolean, same bigint, need bigint, __k1 bigint, __k2 bigint, s int, e int, own boolean"))
    windows = materialize(windows, "windows")
    across = (windows.where("not here").groupBy("host", "h", "same").agg(F.max("need").alias("need"))
              .groupBy("host", "h").agg(F.count("*").alias("n"), F.max("need").alias("need")).where("n >= need").select("host", "h"))
    alone = windows.where("own and not here").join(across, ["host", "h"], "left_semi")
    spans = windows.where("own and here").select("__k1", "__k2", "s", "e").unionByName(alone.select("__k1", "__k2", "s", "e"))
    return spans.groupBy("__k1", "__k2").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def unique_runs(text: str, spans: list[tuple[int, int]]) -> str:
    cut = {i for s, e in spans for i in range(s, e)}
    return " ".join(x for i, x in enumerate(text.split("\n")) if i not in cut).strip()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """Per page: ``id_col``, ``url_col``, text, n_chars.

    Character references are decoded, white space inside a block is one space,
    blocks are joined by one space in page order.  The text is that of article
    containers, or of a page without one what stands outside of menus and the
    like, or if there is none the text of these; less runs of whole blocks that
    SHARE of its host's pages have, PAGES at least.  A null html has no text; pages
    of any length are read whole, in time linear in it; pages without
    host form a group of their own; near copies count as one page; an empty
    table gives no rows; other columns are not read."""
    kind = pages.schema[id_col].dataType.simpleString()
    keys = _key(pages, id_col, url_col, html_col)
    spans = boilerplate(_streams(pages, keys, url_col, html_col), run)

    def texts(it):
        for b in slices(it):
            out = [zlib.compress(parts(page)[0].encode(), 1) for page in b.column(4).to_pylist()]  # the join moves it
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.binary())], ["__k1", "__k2", "id", "url", "t"])

    src = pages.select(*keys, F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = src.mapInArrow(texts, f"__k1 bigint, __k2 bigint, id {kind}, url string, t binary")

    def cut(it):
        for b in slices(it):
            out = [unique_runs(zlib.decompress(t).decode(), [(x["s"], x["e"]) for x in s or ()])
                   for t, s in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["id", "url", "text"])

    out = (rows.join(spans, ["__k1", "__k2"], "left").select("id", "url", "t", "spans")
           .mapInArrow(cut, f"id {kind}, url string, text string"))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
