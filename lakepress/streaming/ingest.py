"""Streams: exactly-once intake, late rows set aside, windows, and signal suppression with a time to live."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LATE = "48 hours"


def intake(stream: DataFrame, keys: list[str], ts: str = "published_at") -> DataFrame:
    """Each key once; state is dropped once the watermark has passed it."""
    return stream.withWatermark(ts, LATE).dropDuplicatesWithinWatermark(keys)


def flag_late(df: DataFrame, ts: str = "published_at", seen: str = "collected_at") -> DataFrame:
    """is_backfill for rows older than the delay when they came: kept, and left out by live detectors."""
    return df.withColumn("is_backfill", F.col(ts) < F.col(seen) - F.expr(f"INTERVAL {LATE}"))


def tumbling(stream: DataFrame, ts: str, every: str, *keys: str) -> DataFrame:
    return stream.withWatermark(ts, LATE).groupBy(F.window(ts, every), *keys).agg(F.count("*").alias("n"))


def sessions(df: DataFrame, ts: str, gap: str, *keys: str) -> DataFrame:
    return df.groupBy(F.session_window(ts, gap), *keys).agg(F.count("*").alias("n"))


def suppressed(stream: DataFrame, ttl_s: int, key: str = "dedup_key", ts: str = "published_at", late: str = "10 minutes") -> DataFrame:
    """Emitted (key, at_s): an emission silences its key for ttl_s seconds of event time.

    State is one number for each live key, and goes when the watermark has passed its time to live. A batch's rows
    come to their key's task in parts; only their times are held.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in np.unique(np.concatenate([p["at_s"].to_numpy() for p in parts])).tolist():
            if last is None or t >= last + ttl_s:
                last = int(t)
                out.append(last)
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl_s) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "at_s": out})

    timed = stream.withWatermark(ts, late).withColumn("at_s", F.unix_seconds(ts))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} string, at_s long", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def split_errors(df: DataFrame, error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters)"""
    return df.where(F.col(error).isNull()), df.where(F.col(error).isNotNull())


def drain(stream: DataFrame, write, checkpoint: str):
    """Process what is there in bounded batches and stop; write(df, epoch) stores one batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
