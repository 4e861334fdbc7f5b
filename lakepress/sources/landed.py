"""Landed folders as a data source: messages of channels and fetched files, in batch and as a stream with offsets by number.

A landed folder holds `<group>/<first>-<last>.jsonl`: lines {"n", "at", "body"} numbered first to last. For posts the group
is a channel and n the message id; for feeds and sitemaps the group is the source, n the fetch and body the file's text.
Names tell what is new, so planning reads no file; the parsers of `feeds` then take the rows apart in Spark.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "grp string, n long, at timestamp, body string"
ARROW = pa.schema([("grp", pa.string()), ("n", pa.int64()), ("at", pa.timestamp("us", tz="UTC")), ("body", pa.string())])
#: Numbers to a landed file; rows of an Arrow batch; bytes of files to a reader's partition.
BLOCK, ROWS, BYTES = 1000, 1000, 64 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/", 1)[0] else (fs.LocalFileSystem(), path)


class Part(InputPartition):
    """Files of one group (path) with the numbers wanted of them: after < n <= until (None: all)."""

    def __init__(self, files: list[tuple[str, str, int | None, int | None]]):
        self.files = files


class _Files:
    """What batch and stream share: listing by names, packing into partitions, reading of lines."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("bytes", BYTES))

    def listed(self) -> list[tuple[str, int, int, str, int]]:
        """(group, first, last, file, size) of every landed file; other files are passed over."""
        files, root = _open(self.path)
        out = []
        for i in files.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            first, dash, last = i.base_name.removesuffix(".jsonl").partition("-")
            if i.is_file and i.base_name.endswith(".jsonl") and dash and first.isdigit() and last.isdigit():
                out.append((unquote(i.path.rsplit("/", 2)[-2]), int(first), int(last), i.path, i.size or 0))
        return sorted(out)

    def packed(self, after: dict, until: dict | None) -> list[Part]:
        parts, size = [], 0
        for group, first, last, file, n_bytes in self.listed():
            low, high = after.get(group), None if until is None else until.get(group, -1)
            if (low is not None and last <= low) or (high is not None and first > high):
                continue
            if not parts or size + n_bytes > self.bytes:
                parts, size = [*parts, Part([])], 0
            parts[-1].files.append((group, file, low, high))
            size += n_bytes
        return parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        for group, file, low, high in partition.files:
            rows: list[tuple] = []
            with files.open_input_stream(file) as raw:
                for line in _lines(raw):
                    m = json.loads(line)
                    if (low is None or m["n"] > low) and (high is None or m["n"] <= high):
                        rows.append((group, m["n"], m["at"], m["body"]))
                    if len(rows) == ROWS:
                        yield _batch(rows)
                        rows = []
            if rows:
                yield _batch(rows)


def _lines(raw, size: int = 1 << 20) -> Iterator[bytes]:
    rest: list[bytes] = []
    while block := raw.read(size):
        head, *more = block.split(b"\n")
        rest.append(head)
        for m in more:
            yield b"".join(rest)
            rest = [m]
    if any(rest):
        yield b"".join(rest)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.record_batch([pa.array(c, pa.int64()).cast(f.type) if f.name == "at" else pa.array(c, f.type) for f, c in zip(ARROW, columns, strict=True)], ARROW)


class LandedReader(_Files, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.after = json.loads(options.get("after", "{}"))

    def partitions(self) -> list[Part]:
        return self.packed(self.after, None)


class LandedStream(_Files, DataSourceStreamReader):
    """Offsets: the last number of each group. A group's numbers only grow; what lands at or below its offset is not read."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.after = json.loads(options.get("after", "{}"))

    def initialOffset(self) -> dict:
        return self.after

    def latestOffset(self) -> dict:
        last = dict(self.after)
        for group, _, n, _, _ in self.listed():
            last[group] = max(n, last.get(group, n))
        return last

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.packed(start, end)

    def commit(self, end: dict) -> None:
        """Landed files stay: they are the record from which a lost stream starts again."""


class LandedSource(DataSource):
    """Options: path; after (JSON of group to last known number); bytes (of files to a partition)."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LandedReader:
        return LandedReader(dict(self.options))

    def streamReader(self, schema) -> LandedStream:
        return LandedStream(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedSource)


def land(rows: DataFrame, folder: str, block: int = BLOCK) -> int:
    """Writes rows (grp, n, at, body) as a landed folder; how many were written. Rows without grp or n, or with n below 0, are left out.

    Numbers go into files by blocks, so a large group is spread over tasks. A file is named by its first and last number
    and holds what its rows say, so a task that runs again writes the same file again; it has its name only when whole.
    """

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        key, low, high, n, f, temporary = None, 0, 0, 0, None, ""

        def close() -> None:
            if f is not None:
                f.close()
                files.move(temporary, f"{root}/{quote(key[0], safe='')}/{low}-{high}.jsonl")

        for p in parts:
            for g, first, m, at, body in zip(*[p.column(c).to_pylist() for c in ("grp", "first", "n", "at_us", "body")], strict=True):
                if key != (g, first):
                    close()
                    key, low = (g, first), m
                    files.create_dir(f"{root}/{quote(g, safe='')}")
                    temporary = f"{root}/{quote(g, safe='')}/{uuid.uuid4().hex}.tmp"
                    f = files.open_output_stream(temporary)
                high, n = m, n + 1
                f.write(json.dumps({"n": m, "at": at, "body": body}, ensure_ascii=False).encode() + b"\n")
        close()
        yield pa.record_batch([pa.array([n], pa.int64())], ["n"])

    known = rows.where("grp IS NOT NULL AND grp <> '' AND n >= 0").select("grp", (F.floor(F.col("n") / block) * block).alias("first"), "n", F.unix_micros("at").alias("at_us"), "body")
    x = known.repartition("grp", "first").sortWithinPartitions("grp", "first", "n", "at_us", "body")
    return x.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def posts(landed: DataFrame) -> DataFrame:
    """Landed rows as posts of channels, in the columns that feeds.channel_posts takes."""
    return landed.select(F.col("grp").alias("channel"), F.col("n").alias("post_id"), F.col("body").alias("text"), "at")


def read(spark: SparkSession, folder: str, after: dict[str, int] | None = None) -> DataFrame:
    """The landed rows with numbers beyond those of `after`; groups that it does not name are read whole."""
    register(spark)
    return spark.read.format("landed").option("path", folder).option("after", json.dumps(after or {})).load()


def read_stream(spark: SparkSession, folder: str, after: dict[str, int] | None = None) -> DataFrame:
    register(spark)
    return spark.readStream.format("landed").option("path", folder).option("after", json.dumps(after or {})).load()


def drain_to(stream: DataFrame, out: str) -> DataFrame:
    """Appends what has landed since the last call to the table below `out`, each row once, and returns that table."""
    q = stream.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{out}/rows")
