"""Streams over the domain views, run to their end; the oracles follow each emission to the next signal beyond its silence."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from ..streaming import suppression
from .engines import emissions, query

_AT = "CAST(floor(epoch_us(published_at) / 1000000) AS BIGINT)"
_KEY = "CASE source_id % 4 WHEN 0 THEN 'velocity_spike' WHEN 1 THEN 'tone_shift' WHEN 2 THEN 'notable_event' ELSE 'sanctions_escalation' END || ':' || source_id"
_TTL = "CASE source_id % 4 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 48 ELSE 72 END * 3600"
#: Signals of every third source are silenced from before by one that was stored.
_STORED = "SELECT source_id, min(published_at) + INTERVAL 30 HOUR AS expires_at FROM articles WHERE source_id % 3 = 0 GROUP BY 1"
_EVENTS = f"SELECT {_KEY} AS dedup_key, {_AT} AS at_s, {_TTL} AS ttl_s FROM articles a LEFT JOIN ({_STORED}) s USING (source_id) WHERE expires_at IS NULL OR {_AT} >= floor(epoch_us(expires_at) / 1000000)"


@query("ST5_suppression_stream", emissions(_EVENTS, ", at_s + ttl_s AS expires_s"))
def st5s(v, t):
    """Four portions of signals, up to four hours out of order, each drained by a run that goes on from the state of the last."""
    kinds = [("velocity_spike", 12), ("tone_shift", 24), ("notable_event", 48), ("sanctions_escalation", 72)]
    kind = lambda c: F.element_at(F.array(*[F.lit(x[c]) for x in kinds]), (F.col("source_id") % 4 + 1).cast("int"))
    key = F.concat(kind(0), F.lit(":"), F.col("source_id").cast("string"))
    a = v("articles")
    spark = a.sparkSession
    folder, out = (f"{shared_dir(spark)}/lakepress/{x}-{uuid.uuid4().hex}" for x in ("signals", "emitted"))
    came = F.unix_seconds("published_at") + F.col("article_id") % 5 * 3600
    signals = a.select(key.alias("dedup_key"), F.col("published_at").alias("at"), (kind(1) * 3600).cast("long").alias("ttl_s"), came.alias("came"))
    end = spark.createDataFrame([("end", 1 << 32)], "dedup_key string, s long").select("dedup_key", F.timestamp_seconds("s").alias("at"), F.lit(1).cast("long").alias("ttl_s"))
    stored = a.where("source_id % 3 = 0").groupBy("source_id").agg((F.min("published_at") + F.expr("INTERVAL 30 HOUR")).alias("expires_at")).select(key.alias("dedup_key"), "expires_at")
    cuts = signals.agg(F.percentile_approx("came", [0.25, 0.5, 0.75])).first()[0] or []
    bounds = [None, *cuts, None]
    emitted = None
    for low, high in zip(bounds, bounds[1:], strict=False):
        portion = signals.where(F.lit(True) if low is None else F.col("came") >= low).where(F.lit(True) if high is None else F.col("came") < high).drop("came")
        (portion if high is not None else portion.unionByName(end)).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(portion.schema).parquet(folder)
        emitted = suppression.run_to(spark, suppression.suppressed(stream, "6 hours", stored), out)
    return emitted.where("dedup_key <> 'end'")
