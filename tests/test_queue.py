"""The queue: bad rows, bounded batches, a crash between staging and commit, restarts, replays."""

import pytest
from pyspark.sql import functions as F

from lakepress.streaming import queue

SCHEMA, NEEDS = "id long, at timestamp, text string", ["id", "at"]
ROWS = ['{"id":%d,"at":"2024-01-0%dT00:00:00","text":"t"}' % (k, k % 9 + 1) for k in range(20)]
BAD = ["", "{", "[1]", '{"id":"x","at":"2024-01-01T00:00:00"}', '{"at":"2024-01-01T00:00:00"}', '{"id":7}', '{"id":8,"at":null}', None]


def land(spark, folder, values, attempt=1, parts=4):
    spark.createDataFrame([(v, attempt) for v in values], queue.MESSAGE).repartition(parts).write.parquet(folder)


def ids(spark, out):
    return sorted(r.id for r in queue.stored(spark, out)[0].collect())


def test_parsing(spark):
    df = spark.createDataFrame([(v, 1) for v in [*BAD, ROWS[0]]], queue.MESSAGE)
    errors = [r.error for r in queue.parsed(df, SCHEMA, NEEDS).collect()]
    assert errors[1] == errors[3] == "malformed" and errors[4:] == ["no_id", "no_at", "no_at", "malformed", None]
    assert errors[0] in ("malformed", "no_id") and errors[2] in ("malformed", "no_id")


def test_restart_repeats_and_loses_none(spark, tmp_path, monkeypatch):
    landing, out = f"{tmp_path}/landing", f"{tmp_path}/out"
    land(spark, f"{landing}/a", ROWS + BAD)
    real, calls = queue.store, []

    def breaking(*how):
        write = real(*how)

        def once(batch, epoch):
            calls.append(epoch)
            if len(calls) == 2:  # staged, but not committed
                queue.parsed(batch, SCHEMA, NEEDS).limit(1).write.mode("overwrite").parquet(f"{out}/rows/epoch={epoch}")
                raise RuntimeError("lost")
            write(batch, epoch)

        return once

    monkeypatch.setattr(queue, "store", breaking)
    with pytest.raises(Exception, match="lost"):
        queue.drain_queue(spark, landing, out, SCHEMA, NEEDS, files=1)
    assert calls == [0, 1] and 0 < len(ids(spark, out)) < 20
    queue.drain_queue(spark, landing, out, SCHEMA, NEEDS, files=1)
    assert calls == [0, 1, 1, 2, 3] and ids(spark, out) == list(range(20))
    assert queue.stored(spark, out)[1].count() == len(BAD)
    queue.drain_queue(spark, landing, out, SCHEMA, NEEDS)
    assert ids(spark, out) == list(range(20))
    # a batch that comes once more changes nothing
    again = spark.read.parquet(f"{out}/rows/epoch=0").select("value", "attempt").collect()
    real(out, SCHEMA, NEEDS)(spark.createDataFrame(again, queue.MESSAGE), 0)
    assert ids(spark, out) == list(range(20))


def test_replay(spark, tmp_path):
    landing, out = f"{tmp_path}/landing", f"{tmp_path}/out"
    land(spark, f"{landing}/a", ROWS[:3] + ['{"id":50,"at":"2024-01-01T00:00:00"', "never"], parts=1)
    queue.drain_queue(spark, landing, out, SCHEMA, NEEDS)
    mend = lambda c: F.concat(c, F.lit("}"))
    for _ in range(2):  # the second time changes nothing
        assert queue.replay(spark, out, landing, mend, most=3) == 1
    queue.drain_queue(spark, landing, out, SCHEMA, NEEDS)
    assert ids(spark, out) == [0, 1, 2, 50]
    assert queue.replay(spark, out, landing, mend, most=3) == 2  # batch 0's are there already, batch 1's are new
    queue.drain_queue(spark, landing, out, SCHEMA, NEEDS)
    queue.replay(spark, out, landing, mend, most=3)
    queue.drain_queue(spark, landing, out, SCHEMA, NEEDS)
    assert ids(spark, out) == [0, 1, 2, 50]
    assert sorted((r.value, r.attempt) for r in queue.stored(spark, out)[1].collect() if "never" in r.value) == [("never", 1), ("never}", 2), ("never}}", 3)]
