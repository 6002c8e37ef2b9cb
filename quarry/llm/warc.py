"""Operator 4: WARC archives with a two-level capture index.

Archives are written by tasks as gzip members, one per record.  Captures are
range-sorted by reversed-host URL key into compressed index blocks; a sparse
directory has one row per block.  A look-up takes a table of URLs: tasks
binary-search their piece of the directory, then the block, then read the
records' byte ranges.  Files go to the shared folder;
only those that the written capture and directory tables name are ever read, so
what a lost or repeated task leaves behind has no effect.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .common import materialize, slices

#: Payloads shorter than this are never revisits.
LEAST = 100
#: Captures in an index block.
BLOCK = 1024
#: Keys that cut the directory into the pieces which tasks search, and the
#: characters of each: what a look-up broadcasts is no larger than these.
FENCES, FENCE_CHARS = 4096, 256
#: Bytes of an archive that one reading task takes.
STRETCH = 16 << 20
_HOST = re.compile(r"^(?:www\d*\.)")


def url_key(url: str | None) -> str:
    """Reversed-host key: http://www.a.example.org:80/x?y -> org,example,a)/x?y

    Tabs and line ends, which part an index block, are percent-encoded."""
    try:
        u = urlsplit((url or "").strip())
        host = _HOST.sub("", (u.hostname or "").lower())
        port = f":{u.port}" if u.port and u.port not in (80, 443) else ""
        path = (u.path or "/") + (f"?{u.query}" if u.query else "")
        key = ",".join(reversed(host.split("."))) + port + ")" + path
    except ValueError:
        key = ")" + (url or "")
    return key.replace("\t", "%09").replace("\n", "%0A")


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; a revisit has the headers only.  Line ends inside a
    URL are percent-encoded."""
    uri = re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url or "")
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}",
            *([f"WARC-Refers-To: <urn:page:{refers_to}>"] if revisit else []),
            "Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else len(payload)}"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + (b"" if revisit else payload) + b"\r\n\r\n")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record as it lies in an archive."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode().split("\r\n")[1:])
    return fields, rest[:int(fields["Content-Length"])]


def _open(uri: str):
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs, path


def _new_file(folder: str, kind: str) -> str:
    from pyspark import TaskContext

    t = TaskContext.get()
    return f"{folder}/{kind}-{t.partitionId():06d}-{uuid.uuid4().hex[:12]}.gz"


def _folder(spark: SparkSession) -> str:
    """A new folder under the shared one, with the scheme of the file system
    that Spark itself takes the shared folder's path to name."""
    p = spark._jvm.org.apache.hadoop.fs.Path(ensure_checkpoint_dir(spark))
    base = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString().rstrip("/")
    return re.sub(r"^file:/+", "file:///", base) + f"/warc-{uuid.uuid4().hex[:12]}"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   least: int = LEAST) -> DataFrame:
    """Write the records and return the captures (key, file, offset, length).

    Payloads are grouped by SHA-256 and length, counted before the shuffle; the
    record with the least id is the response, the others refer to it."""
    d = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    d = d.withColumn("digest", F.sha2("html", 256))
    first = materialize(d.where(F.octet_length("html") >= least).groupBy("digest")
                        .agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "digests")
    d = d.join(first, "digest", "left").select(
        "id", "url", "html", "digest", F.when((F.col("id") > F.col("first")) | F.col("id").isNull(), F.col("first")).alias("refers"))

    def run(it):
        out, offset, name = None, 0, _new_file(folder, "archive.warc")
        fs, path = _open(name)
        for b in slices(it):
            rows: list[tuple] = []
            for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(path, compression=None)
                data = record(page_id, url, html.encode(), digest, refers)
                out.write(data)
                rows.append((url_key(url), name, offset, len(data)))
                offset += len(data)
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0]), pa.array(c[1]), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64())],
                                                 ["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialize(d.mapInArrow(run, "key string, file string, offset bigint, length bigint"), "captures")


def write_index(captures: DataFrame, folder: str, block: int = BLOCK) -> DataFrame:
    """Range-sort the captures into compressed blocks and return the sparse
    directory: first_key, last_key, file, offset, length, captures of each."""

    def run(it):
        out, offset, name = None, 0, _new_file(folder, "index.cdx")
        fs, path = _open(name)

        def put(lines):
            nonlocal out, offset
            if out is None:
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                out = fs.open_output_stream(path, compression=None)
            data = _member("".join("\t".join(map(str, x)) + "\n" for x in lines).encode())
            out.write(data)
            offset += len(data)
            return pa.RecordBatch.from_pydict({
                "first_key": [lines[0][0]], "last_key": [lines[-1][0]], "file": [name],
                "offset": pa.array([offset - len(data)], pa.int64()), "length": pa.array([len(data)], pa.int64()),
                "captures": pa.array([len(lines)], pa.int64())})

        held: list[tuple] = []
        for b in slices(it, 4096):
            held += zip(*(c.to_pylist() for c in b.columns), strict=True)
            while len(held) >= block:
                yield put(held[:block])
                held = held[block:]
        if held:
            yield put(held)
        if out is not None:
            out.close()

    cols = ["key", "file", "offset", "length"]
    return materialize(captures.select(*cols).repartitionByRange(*cols).sortWithinPartitions(*cols).mapInArrow(
        run, "first_key string, last_key string, file string, offset bigint, length bigint, captures bigint"), "directory")


def read_block(file: str, offset: int, length: int) -> list[list[str]]:
    """Captures [key, file, offset, length] of one index block, in key order."""
    fs, path = _open(file)
    with fs.open_input_file(path) as f:
        raw = zlib.decompress(f.read_at(length, offset), 31).decode()
    return [line.split("\t") for line in raw.split("\n")[:-1]]


def fences(directory: DataFrame, most: int = FENCES) -> list[str]:
    """Sorted keys, about ``most`` at most, that cut the directory into pieces of
    like size: first keys of blocks, thinned by hash and cut to FENCE_CHARS."""
    step = -(-max(1, directory.count()) // most)
    rows = directory.where(F.pmod(F.xxhash64("first_key", "file", "offset"), F.lit(step)) == 0)
    return sorted({r[0] for r in rows.select(F.substring("first_key", 1, FENCE_CHARS)).distinct().collect()})


def lookup(directory: DataFrame, urls: DataFrame, url_col: str = "url", most: int = FENCES) -> DataFrame:
    """Captures (file, offset, length) of all URLs of a table, each once however
    often the table has its URL; URLs that the index lacks give none.

    Keys and directory are dealt by the fences between which they lie.  A task
    binary-searches its piece of the directory for each key, and blocks are read
    once each and binary-searched for the keys that point there.  A block of one
    key only needs no search: it is joined by this key, so a hot URL's blocks are
    held by no task."""
    cuts = fences(directory, most)

    def keys(it):
        for b in slices(it, 4096):
            k = list({url_key(u) for u in b.column(0).to_pylist()})
            yield pa.RecordBatch.from_pydict({"piece": pa.array([bisect.bisect_right(cuts, x) for x in k], pa.int32()), "key": pa.array(k, pa.string())})

    def dealt(it):
        for b in slices(it, 4096):
            first, last = b.column(0).to_pylist(), b.column(1).to_pylist()
            row, piece = [], []
            for i, (x, y) in enumerate(zip(first, last, strict=True)):
                for p in range(bisect.bisect_right(cuts, x), bisect.bisect_right(cuts, y) + 1):
                    row.append(i)
                    piece.append(p)
            t = b.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), *t.columns], ["piece", "key", "last", "file", "offset", "length"])

    def search(it):
        at, first, rows = None, [], []
        for b in slices(it, 4096):
            out = []
            for piece, key, last, *where in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if piece != at:
                    at, first, rows = piece, [], []
                if last is not None:  # blocks come before keys
                    first.append(key)
                    rows.append((last, where))
                    continue
                i = bisect.bisect_right(first, key) - 1
                out += [(*w, key) for end, w in rows[max(0, i - 1):i + 1] if key <= end]
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("file", "offset", "length", "key"), r, strict=True)) for r in out],
                                                 pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.string())]))

    def captures(it):
        held, lines = None, []
        for b in slices(it):
            out = []
            for file, offset, length, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held != (file, offset):
                    held, lines = (file, offset), read_block(file, offset, length)
                i = bisect.bisect_left(lines, key, key=lambda x: x[0])
                while i < len(lines) and lines[i][0] == key:
                    out.append(lines[i][1:])
                    i += 1
            if out:
                yield pa.RecordBatch.from_pydict({"file": [x[0] for x in out], "offset": pa.array([int(x[1]) for x in out], pa.int64()),
                                                  "length": pa.array([int(x[2]) for x in out], pa.int64())})

    where = "file string, offset bigint, length bigint"
    wanted = urls.select(F.col(url_col).cast("string")).mapInArrow(keys, "piece int, key string").distinct()
    blocks = directory.select("first_key", "last_key", "file", "offset", "length")
    mixed = blocks.where("first_key < last_key").mapInArrow(dealt, f"piece int, key string, last string, {where}")
    both = mixed.unionByName(wanted, allowMissingColumns=True).select("piece", "key", "last", "file", "offset", "length")
    found = (both.repartition("piece").sortWithinPartitions("piece", F.col("last").isNull(), "key")
             .mapInArrow(search, f"{where}, key string"))
    single = (blocks.where("first_key = last_key").withColumnRenamed("first_key", "key").join(wanted.select("key"), "key")
              .select("file", "offset", "length", "key"))
    return (found.unionByName(single).repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
            .mapInArrow(captures, where))


def scan(directory: DataFrame) -> DataFrame:
    """Captures (file, offset, length) of the whole index, block by block."""

    def captures(it):
        for b in slices(it, 16):
            for file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = read_block(file, offset, length)
                yield pa.RecordBatch.from_pydict({"file": [x[1] for x in lines], "offset": pa.array([int(x[2]) for x in lines], pa.int64()),
                                                  "length": pa.array([int(x[3]) for x in lines], pa.int64())})

    return (directory.select("file", "offset", "length").repartition("file", "offset")
            .mapInArrow(captures, "file string, offset bigint, length bigint"))


def read_records(captures: DataFrame, id_type: str = "bigint") -> DataFrame:
    """Captures read back from the archives by byte range: page_id, url,
    payload_bytes, payload_digest, record_type, refers_to.  The digest of a
    response is computed anew from its payload."""

    def records(it):
        name, f = None, None
        for b in slices(it):
            rows: list[tuple] = []
            for file, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if file != name:
                    if f is not None:
                        f.close()
                    fs, path = _open(file)
                    name, f = file, fs.open_input_file(path)
                h, payload = parse(f.read_at(length, offset))
                revisit = h["WARC-Type"] == "revisit"
                digest = h["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                own = h["WARC-Record-ID"][len("<urn:page:"):-1]
                rows.append((own or None, h["WARC-Target-URI"], int(h["X-Payload-Length"]) if revisit else len(payload), digest,
                             h["WARC-Type"], h["WARC-Refers-To"][len("<urn:page:"):-1] if revisit else None))
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if i == 2 else pa.string()) for i, x in enumerate(c)],
                                                 ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
        if f is not None:
            f.close()

    reads = (captures.withColumn("stretch", F.floor(F.col("offset") / STRETCH))
             .repartition("file", "stretch").sortWithinPartitions("file", "offset"))
    out = reads.mapInArrow(records, "page_id string, url string, payload_bytes bigint, payload_digest string, "
                                    "record_type string, refers_to string")
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write archives and index of ``pages`` and look all of its URLs up again:
    ``id_col``, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload, a null url an empty target.  Rows that
    repeat the least id of a payload are all responses; a null id is a revisit
    if an equal payload has an id.  Texts of any length are written and read as
    one record.  An empty table writes nothing and gives no rows; other columns
    are not read."""
    folder = _folder(pages.sparkSession)
    directory = write_index(write_archives(pages, folder, id_col, url_col, html_col), folder)
    return read_records(lookup(directory, pages, url_col), pages.schema[id_col].dataType.simpleString()).select(
        F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
