"""A queue of landed messages drained in bounded batches: records and dead letters under one commit, and their replay."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ingest import drain, split_errors

MESSAGE = "value string, attempt int"


def parsed(raw: DataFrame, schema: str, needs: list[str]) -> DataFrame:
    """raw (value, attempt) with `record` and `error`: malformed (no JSON of the schema), no_<field> for the first need that is null, or null."""
    x = raw.withColumn("record", F.from_json("value", f"{schema}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("record").isNull() | F.col("record._corrupt").isNotNull()
    error = F.when(bad, "malformed")
    for c in needs:
        error = error.when(F.col(f"record.{c}").isNull(), f"no_{c}")
    return x.withColumn("error", error).withColumn("record", F.when(F.col("error").isNull(), F.col("record").dropFields("_corrupt")))


def messages(spark: SparkSession, landing: str, files: int) -> DataFrame:
    """The stream of messages below a folder, so many files a batch."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(landing)


def store(out: str, schema: str, needs: list[str]) -> Callable[[DataFrame, int], None]:
    """Writes one batch: its rows are staged under the batch's number, then the number is committed.

    A batch that comes again after a crash overwrites what it had staged, and one that had been committed gives the same
    rows again; a batch that is staged but not committed is not seen.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        parsed(batch, schema, needs).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
        batch.sparkSession.range(1).select(F.lit(epoch).cast("long").alias("number")).coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/epoch={epoch}")

    return write


def drain_queue(spark: SparkSession, landing: str, out: str, schema: str, needs: list[str], files: int = 100) -> None:
    """Drains what has landed and returns; a later call, or one after a crash, goes on behind the last whole batch."""
    drain(messages(spark, landing, files), store(out, schema, needs), f"{out}/checkpoint").awaitTermination()


def stored(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(records with epoch and attempt, dead letters: epoch, value, attempt, error) of the committed batches."""
    commits = spark.read.parquet(f"{out}/commits").select(F.col("number").alias("epoch")).distinct()
    rows = spark.read.parquet(f"{out}/rows").withColumn("epoch", F.col("epoch").cast("long")).join(commits, "epoch", "left_semi")
    good, dead = split_errors(rows)
    return good.select("record.*", "epoch", "attempt"), dead.select("epoch", "value", "attempt", "error")


def replay(spark: SparkSession, out: str, landing: str, mend: Callable[[Column], Column] = lambda value: value, most: int = 3) -> int:
    """Lands the dead letters that have had fewer than `most` attempts anew, each batch's once; how many batches that were.

    An epoch's letters go into a folder of its number; one that is there already is left alone, so to replay again
    changes nothing.
    """
    _, dead = stored(spark, out)
    again = dead.where(F.col("attempt") < most)
    epochs = [r.epoch for r in again.select("epoch").distinct().collect()]  # a number a batch
    for e in sorted(epochs):
        again.where(F.col("epoch") == e).select(mend(F.col("value")).alias("value"), (F.col("attempt") + 1).alias("attempt")).write.mode("ignore").parquet(f"{landing}/replay-{e}")
    return len(epochs)
