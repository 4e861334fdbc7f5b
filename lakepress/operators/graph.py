"""Connected components over an edge table, without leaving Spark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: the cluster's spark.checkpoint.dir.

    Only in a local session, as in tests, a temporary folder takes its place; elsewhere the setting must be there,
    since a machine's own folder would lose data silently.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        own = spark.sparkContext.getCheckpointDir()
        if own:
            return own
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = "file://" + tempfile.mkdtemp(prefix="lakepress-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to a fresh table in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lakepress/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of an edge (u, v); component is the smallest node reachable.

    Alternating large-star and small-star steps; each halves the depth of every tree, so the rounds grow with
    the logarithm of the longest path. Nodes may be of any orderable type. Null ends and self loops are left out
    (a node that has only a self loop is not returned). An empty edge table gives an empty result.
    """
    e = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = materialize(small.where("u <> v").distinct(), "edges")
        # done when every edge leads from a node of one edge to a node of none
        ends = e.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR (below = 1 AND above = 1)").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))
