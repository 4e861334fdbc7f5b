"""Suppression in a stream equals that over the whole history: late rows, restarts, stored signals, types' times to live."""

import datetime
import random

from pyspark.sql import functions as F

from lakepress.operators.signals import TTL_HOURS, suppress_history
from lakepress.streaming import suppression

SCHEMA = "dedup_key string, at timestamp, ttl_s long"
START = 1_704_067_200


def land(spark, folder, rows):
    at = lambda s: None if s is None else datetime.datetime.fromtimestamp(s, datetime.timezone.utc)
    spark.createDataFrame([(k, at(s), t) for k, s, t in rows], SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def drain(spark, folder, out, stored=None):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    rows = suppression.run_to(spark, suppression.suppressed(stream, "6 hours", stored), out)
    return sorted((r.dedup_key, r.at_s) for r in rows.collect())


def test_equals_the_history(spark, tmp_path):
    rng, folder, out = random.Random(5), str(tmp_path / "in"), str(tmp_path / "out")
    ttl = {k: h * 3600 for k, h in TTL_HOURS.items()}
    events = [(f"{k}:{c}", START + 1800 * rng.randrange(600), ttl[k]) for k in ttl for c in "ab" for _ in range(30)]
    events.sort(key=lambda e: e[1] + rng.randrange(5 * 3600))  # out of order by less than the delay
    third = len(events) // 3
    for k in range(3):  # each a run of its own: state comes from the checkpoint
        land(spark, folder, events[k * third : (k + 1) * third if k < 2 else None])
        seen = drain(spark, folder, out)
    assert len(seen) == len(set(seen))
    land(spark, folder, [("end", START + 10**7, 1), (None, START, 1), ("x", None, 1), ("x", START, None), ("x", START + 10**10, 1)])
    drain(spark, folder, out)
    land(spark, folder, [("end", START + 5, 1), ("tone_shift:a", START + 7, 1)])  # beyond the delay: dropped
    got = [e for e in drain(spark, folder, out) if e[0] != "end"]
    want = []
    for kind, t in ttl.items():
        mine = spark.createDataFrame([(k, s) for k, s, _ in events if k.startswith(f"{kind}:")], "dedup_key string, at_s long")
        want += [(r.dedup_key, r.at_s) for r in suppress_history(mine, t).collect()]
    assert got == sorted(want) and len(got) > 100


def test_stored_signals_silence_first(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    stored = spark.createDataFrame([("a", START + 50), ("a", START + 100), ("b", START - 9), (None, START)], "dedup_key string, e long").select("dedup_key", F.timestamp_seconds("e").alias("expires_at"))
    land(spark, folder, [("a", START + 60, 500), ("a", START + 100, 20), ("a", START + 110, 20), ("a", START + 120, 20), ("b", START, 5), ("b", START, 7), ("b", START + 6, 5), ("end", START + 10**6, 1)])
    assert [e for e in drain(spark, folder, out, stored) if e[0] != "end"] == [("a", START + 100), ("a", START + 120), ("b", START)]
