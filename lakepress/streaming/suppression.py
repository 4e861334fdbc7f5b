"""Signals suppressed in a stream: an emitted signal silences its key for its type's time to live, in event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "dedup_key string, at_s long, expires_s long"


class Suppressor(StatefulProcessor):
    """Per key: the time its last emission's silence ends, and the signals that the watermark has not passed.

    A signal waits in a list until the watermark passes it, so signals that come out of order by less than the
    watermark's delay are judged in order. The first waiting time has a timer, and so has the end of a silence, at which a
    key without waiting signals is forgotten: state holds live keys alone. A timer judges all that is due and sets the
    next one, so a key's list is read once for a batch, however many signals it has.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.silent = handle.getValueState("silent", "until_s long")
        self.waiting = handle.getListState("waiting", "at_s long, ttl_s long")
        self.next = handle.getValueState("next", "at_s long")

    def wake(self, at: int) -> None:
        """The timer of the first waiting time, the only one for what waits."""
        if self.next.exists():
            if self.next.get()[0] <= at:
                return
            self.handle.deleteTimer(self.next.get()[0] * 1000)
        self.next.update((at,))
        self.handle.registerTimer(at * 1000)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        until = int(initialState["until_s"].max())
        if self.silent.exists():  # the stored signals of a key may come in several parts
            until = max(until, self.silent.get()[0])
        self.silent.update((until,))
        self.handle.registerTimer(until * 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for p in rows:
            new = p.groupby("at_s")["ttl_s"].max()
            self.waiting.appendList([(int(at), int(ttl)) for at, ttl in new.items()])
            first = min(int(new.index[0]), int(new.index[0]) if first is None else first)
        if first is not None:
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() // 1000
        until = self.silent.get()[0] if self.silent.exists() else None
        waits = not self.next.exists() or self.next.get()[0] <= now
        held = sorted((r[0], r[1]) for r in self.waiting.get()) if waits and self.waiting.exists() else []
        out = []
        for i, (at, ttl) in enumerate(held):
            if at > now or (i + 1 < len(held) and held[i + 1][0] == at):  # of one second the longest stands
                continue
            if until is None or at >= until:
                until = at + ttl
                out.append((key[0], at, until))
        later = [x for x in held if x[0] > now]
        if waits and held:
            self.next.clear()
            if later:
                self.waiting.put(later)
                self.wake(later[0][0])
            else:
                self.waiting.clear()
        if out:
            self.silent.update((until,))
            if until > now:
                self.handle.registerTimer(until * 1000)
        # the silence is over for every signal that may still come
        if until is not None and until <= now and not self.next.exists():
            self.silent.clear()
        return iter([pd.DataFrame(out, columns=["dedup_key", "at_s", "expires_s"])] if out else ())

    def close(self) -> None:
        pass


def suppressed(stream: DataFrame, late: str, stored: DataFrame | None = None) -> DataFrame:
    """Emitted (dedup_key, at_s, expires_s) of stream (dedup_key, at timestamp, ttl_s); seconds are whole.

    late: how far behind the newest a signal may come; one that comes later still is dropped. stored (dedup_key,
    expires_at): signals alive when the stream first starts. A signal at the end of a silence is emitted; of signals of
    one key and second the longest time to live stands; those with a null in any column, or
    with a time outside 1900 to 2199 (which would carry the watermark off), are left out. A signal is
    emitted once the watermark has passed its second.
    """
    known = stream.where("dedup_key IS NOT NULL AND year(at) BETWEEN 1900 AND 2199 AND ttl_s IS NOT NULL")
    timed = known.withWatermark("at", late).select("dedup_key", "at", F.unix_seconds("at").alias("at_s"), F.col("ttl_s").cast("long").alias("ttl_s"))
    first = None
    if stored is not None:
        ends = stored.where("dedup_key IS NOT NULL AND expires_at IS NOT NULL").groupBy("dedup_key").agg(F.max(F.unix_seconds("expires_at")).alias("until_s"))
        first = ends.groupBy("dedup_key")
    return timed.groupBy("dedup_key").transformWithStateInPandas(Suppressor(), OUT, "Append", "EventTime", first)


def run_to(spark: SparkSession, emitted: DataFrame, out: str) -> DataFrame:
    """Drains what has landed into the table below `out`, going on from the state of the last call; returns that table."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKS)  # taken over by the query as it starts
    try:
        q = emitted.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    q.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{out}/rows")
