"""WARC archives with a two-level capture index (operator 7).

Pages are written as gzip-per-record WARC files, one file for each task, to the shared folder. Each record's index
row has a sortable key (host labels reversed, then path), page id, digest, type, file, offset and length. Index rows
are range-partitioned, sorted by key and page id and written as compressed blocks; the sparse directory keeps each
block's first and last entry, file, offset and length. The directory's rows are sorted and written as blocks of the
same kind, and what is left is a root of a row for some millions of captures. A reader (`CaptureIndex`) bisects the
root, range-reads a part of the directory, bisects that, inflates one block, bisects it and range-reads the record.

The read plan looks up the pages that it is asked for: their (key, page id) entries are range-partitioned, each task
takes its entries in order, so a block is inflated once for all of its neighbours, and however many captures share a
key, their entries spread over tasks. Nothing of the index goes through the driver.

Equal payloads of at least `min_bytes` bytes: the smallest page id is the response, the others revisit it. Only
(digest, id) pairs are grouped; pages move once at most, and where a payload has very many copies, not at all.

Defined results: a null html is an empty payload; a null url has the empty key; rows repeated with the smallest id
of their payload are all responses; a payload of pages whose ids are all null has responses only; an empty table
writes no archive and reads as empty. A task that is run again writes another file; only files named by the
index, which is written once by a committed job, are ever read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

#: Index rows in a compressed block, and blocks in a part of the directory.
BLOCK_ROWS, DIRECTORY_ROWS = 2000, 1000
BLOCK = "first_key string, first_id long, last_key string, last_id long, file string, start long, size long"
#: Files and inflated blocks that one task's reader keeps.
OPEN_FILES, OPEN_BLOCKS = 64, 16
#: Buckets of payload digests: those with copies go to all tasks as numbers.
BUCKETS = 1 << 20
INDEX = "key string, page_id long, digest string, kind string, refers_to long, n_bytes long, file string, start long, size long"


def url_key(url: str | None) -> str:
    """com,example,www)/path?query in lower case; scheme, user, port, a leading www and the fragment are left out."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip() if "//" in url else "//" + url.strip())
        host = (u.hostname or "").removeprefix("www.")
    except ValueError:
        return url.lower()
    tail = (u.path or "/") + (f"?{u.query}" if u.query else "")
    return ",".join(reversed(host.split("."))) + ")" + tail.lower()


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(url: str) -> str:
    return "".join(c if c > " " else "%20" for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has HTTP headers without a body."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{url}:{digest}')}>",
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": _clean(url or "about:blank"),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Page-ID": "" if page_id is None else str(page_id),
    }
    if revisit:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To-Page-ID": str(refers_to), "WARC-Payload-Bytes": str(len(payload))}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """(WARC headers, payload) of an inflated record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record here")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record of another length")
    return fields, block.partition(b"\r\n\r\n")[2]


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return fs, path


def _write(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top, out, at, name = None, "", None, 0, ""
        for b in batches:
            rows: list[tuple] = []
            if out is None and b.num_rows:
                fs, top = _store(folder)
                fs.create_dir(top, recursive=True)
                name = f"pages-{uuid.uuid4().hex}.warc.gz"
                out = fs.open_output_stream(posixpath.join(top, name), compression=None)
            for page, url, html, first in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "first_id")), strict=True):
                payload = (html or "").encode()
                digest = digest32(payload)
                refers = first if first is not None and first != page else None
                raw = gzip.compress(record(page, url, payload, digest, refers), 5, mtime=0)
                out.write(raw)
                rows.append((url_key(url), page, digest, "response" if refers is None else "revisit", refers, len(payload), name, at, len(raw)))
                at += len(raw)
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
        if out is not None:
            out.close()

    return run


def entry(key: str, page: int | None) -> tuple[str, int]:
    """What index rows are sorted by; a null page id comes first."""
    return key, -(1 << 63) - 1 if page is None else page


def _number(x: str) -> int | None:
    return int(x) if x else None


def _blocks(folder: str, name: str, rows: int):
    """Sorted rows (key and page first) to compressed blocks in one file for each task; yields a row for each block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, file, at, held, found = None, "", 0, [], []

        def flush() -> None:
            nonlocal out, file, at
            if not held:
                return
            if out is None:
                fs, top = _store(folder)
                fs.create_dir(top, recursive=True)
                file = f"{name}-{uuid.uuid4().hex}.gz"
                out = fs.open_output_stream(posixpath.join(top, file), compression=None)
            raw = gzip.compress("".join("\t".join("" if v is None else str(v) for v in r) + "\n" for r in held).encode(), 6, mtime=0)
            out.write(raw)
            first, last = held[0], held[-1]
            found.append((first[0], first[1], last[2] if name == "directory" else last[0], last[3] if name == "directory" else last[1], file, at, len(raw)))
            at += len(raw)
            held.clear()

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(r)
                if len(held) >= rows:
                    flush()
        flush()
        if out is not None:
            out.close()
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=[x.split()[0] for x in BLOCK.split(", ")])

    return run


class CaptureIndex:
    """Look-ups by bisection: root, directory, block, record. Blocks last read are kept, a few at a time."""

    def __init__(self, folder: str):
        self.fs, self.top = _store(folder)
        self.files: OrderedDict[str, object] = OrderedDict()
        self.blocks: OrderedDict[tuple[str, int], list] = OrderedDict()
        root = posixpath.join(self.top, "root")
        found = self.fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        parts = [pq.read_table(self.fs.open_input_file(f.path)) for f in found if f.path.endswith(".parquet") and f.size]
        rows = [tuple(r.values()) for t in parts for r in t.to_pylist()]
        self.root = sorted(rows, key=lambda r: (entry(r[0], r[1]), entry(r[2], r[3])))

    def open(self, name: str):
        if name not in self.files:
            self.files[name] = self.fs.open_input_file(posixpath.join(self.top, name))
            if len(self.files) > OPEN_FILES:
                self.files.popitem(last=False)[1].close()
        self.files.move_to_end(name)
        return self.files[name]

    def block(self, file: str, start: int, size: int) -> list[list[str]]:
        if (file, start) not in self.blocks:
            raw = gzip.decompress(self.open(file).read_at(size, start)).decode()
            self.blocks[file, start] = [line.split("\t") for line in raw.split("\n")[:-1]]
            if len(self.blocks) > OPEN_BLOCKS:
                self.blocks.popitem(last=False)
        self.blocks.move_to_end((file, start))
        return self.blocks[file, start]

    @staticmethod
    def within(rows: list, first, last, low: tuple, high: tuple) -> Iterator:
        """The rows, sorted by their first entries, that may hold entries from low to high."""
        k = bisect.bisect_left(rows, low, key=last)
        while k < len(rows) and first(rows[k]) <= high:
            yield rows[k]
            k += 1

    def rows(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[list[str]]:
        """Index rows whose entries lie from low to high."""
        own = lambda r: entry(r[0], r[1])
        for top in self.within(self.root, own, lambda r: entry(r[2], r[3]), low, high):
            part = self.block(*top[4:7])
            for d in self.within(part, lambda r: entry(r[0], _number(r[1])), lambda r: entry(r[2], _number(r[3])), low, high):
                block = self.block(d[4], int(d[5]), int(d[6]))
                mine = lambda r: entry(r[0], _number(r[1]))
                yield from self.within(block, mine, mine, low, high)

    def capture(self, row: list[str]) -> tuple[dict[str, str], bytes]:
        """The record of an index row, range-read and checked."""
        _, _, digest, _, _, n, name, at, length = row
        head, payload = parse_record(zlib.decompress(self.open(name).read_at(int(length), int(at)), 31))
        got = head["WARC-Payload-Digest"].removeprefix("sha1:")
        if head["WARC-Type"] == "response" and (digest32(payload) != got or len(payload) != int(n)) or got != digest:
            raise ValueError(f"{name} at {at}: not the payload that was written")
        return head, payload

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """All captures of a URL."""
        key = url_key(url)
        return [self.capture(r) for r in self.rows(entry(key, None), (key, 1 << 63))]


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column("url").to_pylist()], pa.string()), b.column("page_id")], names=["key", "page_id"])


def _look_up(folder: str):
    """Distinct entries (key, page_id), sorted, to their records."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = None
        for b in batches:
            index = index or CaptureIndex(folder)
            rows = []
            for key, page in zip(b.column("key").to_pylist(), b.column("page_id").to_pylist(), strict=True):
                for r in index.rows(entry(key, page), entry(key, page)):
                    head, payload = index.capture(r)
                    refers, own = head.get("WARC-Refers-To-Page-ID"), head["WARC-Page-ID"]
                    size = len(payload) if refers is None else int(head["WARC-Payload-Bytes"])
                    rows.append((_number(own), size, head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], _number(refers or ""), head["WARC-Target-URI"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write pages (page_id, url, html) as WARC files, their index, its directory and root below folder."""
    spark = pages.sparkSession
    shared.prepare(spark)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = shared.materialize(p.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("d"), F.octet_length("html").alias("n")).where(F.col("n") >= min_bytes), "digests")
    groups = shared.materialize(keyed.groupBy("d").agg(F.min("page_id").alias("first_id"), F.count("*").alias("c")), "groups")
    first = groups.where("c > 1 AND first_id IS NOT NULL").select("d", "first_id")
    hot = shared.hot_keys(groups, "d", "c")
    rows = p.withColumn("d", F.sha1(F.encode("html", "UTF-8")))
    # pages whose payload has very many copies stay where they are, and so do those of which no copy can be
    bucket = F.pmod(F.xxhash64("d"), F.lit(BUCKETS))
    copied = F.broadcast(first.select(bucket.alias("bucket")).distinct())  # BUCKETS rows at most
    few, rows = F.broadcast(hot), rows.withColumn("bucket", bucket)
    alone = rows.join(copied, "bucket", "left_anti").withColumn("first_id", F.lit(None).cast("long"))
    many = rows.join(copied, "bucket", "left_semi")
    stay = many.join(F.broadcast(few.join(first, "d", "left")), "d")
    move = many.join(few, "d", "left_anti").join(first.hint("merge"), "d", "left")
    cols = ["page_id", "url", "html", F.when(F.octet_length("html") >= min_bytes, F.col("first_id")).alias("first_id")]
    rows = alone.select(*cols).union(stay.select(*cols)).union(move.select(*cols))
    index = shared.materialize(rows.mapInArrow(_write(folder), INDEX), "captures")
    clean = index.withColumn("key", F.regexp_replace(F.regexp_replace("key", "\t", "%09"), "\n", "%0A"))
    order = ["key", "page_id", "file", "start"]
    blocks = clean.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(folder, "index", BLOCK_ROWS), BLOCK)
    directory = shared.materialize(blocks, "directory")
    order = ["first_key", "first_id", "last_key", "last_id", "file", "start"]
    parts = directory.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_blocks(folder, "directory", DIRECTORY_ROWS), BLOCK)
    # only the root's few rows, one for each part of the directory, go through one task
    shared.materialize(parts, "parts").coalesce(1).write.parquet(f"{folder}/root")


def read_archives(pages: DataFrame, folder: str) -> DataFrame:
    """The records of pages (page_id, url), looked up in the index: (page_id, payload_bytes, payload_digest, record_type, refers_to, url).

    Each page row that was written comes back once, however often it is asked for.
    """
    shared.prepare(pages.sparkSession)
    asked = pages.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")).mapInArrow(_keyed, "key string, page_id long")
    asked = asked.select(F.regexp_replace(F.regexp_replace("key", "\t", "%09"), "\n", "%0A").alias("key"), "page_id").distinct()
    asked = shared.materialize(asked, "asked").repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return asked.mapInArrow(_look_up(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
