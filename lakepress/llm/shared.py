"""What the corpus operators share: the shared folder, shipping of this package, Arrow batch sizes."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakepress.operators.graph import connected_components, materialize, shared_dir

__all__ = ["connected_components", "free", "hot_keys", "join_ones", "materialize", "prepare", "shared_dir", "ship", "table", "with_row_key", "without_rows"]


def prepare(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, and send this package to workers that lack it.

    The two settings stay with the session, since plans read them when they run; bounds that are lower already stay.
    """
    for name, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        now = spark.conf.get(name, None)
        if not (now and now.isdigit() and 0 < int(now) <= bound):
            spark.conf.set(name, str(bound))
    sc = spark.sparkContext
    if getattr(sc, "_lakepress_sent", None) == sc.applicationId:
        return
    root = Path(__file__).resolve().parents[2]
    out = os.path.join(tempfile.mkdtemp(prefix="lakepress-"), "lakepress_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((root / "lakepress").rglob("*.py")):
            z.write(p, str(p.relative_to(root)))
    sc.addPyFile(out)
    sc._lakepress_sent = sc.applicationId


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession, path: str) -> Callable[[], str]:
    """A function that gives a driver's file's place in a task: the same path where it exists, else the copy sent along."""
    if getattr(spark.sparkContext, "_lakepress_files", None) is None:
        spark.sparkContext._lakepress_files = set()
    if path not in spark.sparkContext._lakepress_files:
        spark.sparkContext.addFile(path)
        spark.sparkContext._lakepress_files.add(path)
    name = os.path.basename(path)

    def local() -> str:
        return path if os.path.exists(path) else SparkFiles.get(name)

    return local


def free(docs: DataFrame, name: str) -> str:
    """name, or with underscores behind it so that docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot when it holds at least one row in so many; there are no more hot keys than that.
HOT_SHARE = 1000


def hot_keys(counts: DataFrame, key: str, n: str) -> DataFrame:
    """The keys that hold at least a 1 / HOT_SHARE of all rows, so at most HOT_SHARE of them; counts has a row for each key."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    return materialize(counts.where(F.col(n) * HOT_SHARE >= total).select(key), "hot")


def join_ones(many: DataFrame, ones: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """many left-joined with ones, which has a row for each key; the rows of hot keys stay where they are.

    The values of hot keys (at most HOT_SHARE rows) are broadcast; of the other keys none has many rows to shuffle.
    many is read twice, so it should be stored and narrow.
    """
    few = F.broadcast(hot)
    stay = many.join(F.broadcast(ones.join(few, key, "left_semi")), key)
    return stay.unionByName(many.join(few, key, "left_anti").join(ones.hint("merge"), key, "left"))


#: Buckets of text hashes: the ones of a table of rows go to all tasks as numbers, at most so many.
BUCKETS = 1 << 20


def by_bucket(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(docs that cannot be among rows (text_hash, ...), the others), by the bucket of the text's hash; neither is moved."""
    b = free(docs, "bucket")
    found = F.broadcast(rows.select(F.pmod("text_hash", F.lit(BUCKETS)).alias(b)).distinct())
    on = F.pmod(F.xxhash64("text"), F.lit(BUCKETS)) == F.col(b)
    return docs.join(found, on, "left_anti"), docs.join(found, on, "left_semi")


def with_row_key(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of docs (doc_id, text, ...) that are among rows (doc_id, text_hash) or, by `how`, that are not; null ids are equal.

    Only rows in a bucket of rows are shuffled. docs is read twice.
    """
    i, h = free(docs, "row_id"), free(docs, "row_hash")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))
    apart, maybe = by_bucket(docs, rows)
    met = maybe.join(rows.select(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).hint("merge"), on, how)
    return met if how == "left_semi" else apart.unionByName(met)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id and text hash are among gone (doc_id, text_hash): by row, not by id alone."""
    return with_row_key(docs, materialize(gone.select("doc_id", "text_hash").where("text_hash IS NOT NULL").distinct(), "gone"), "left_anti")
