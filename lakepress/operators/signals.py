"""Anomaly signals over the star of labelled articles; each detector covers all countries in one plan.

Every detector returns (signal_type, country_code, subject, severity, confidence, dedup_key, ttl_h). A key with a day
in it can come again the next day; one without is silent as long as its signal lives.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LOUD_TIERS = ["social", "domestic_opposition", "independent", "western_proxy"]
QUIET_TIERS = ["official", "mainstream"]
TTL_HOURS = {"tier_convergence": 24, "official_silence": 24, "velocity_spike": 12, "tone_shift": 24, "volume_surge": 24, "index_shift": 24, "fx_move": 24, "notable_event": 48, "sanctions_escalation": 72}
ANCHOR = r"russia|росси|кремл|kreml|putin|путин|moscow|москв|лавров|lavrov|одкб|csto|еаэс|eaeu|\bснг\b|\bсоюз"


def _recent(star: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return star.where(F.col("is_relevant") & ~F.col("is_backfill") & (F.col("published_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))))


def _keyed(star: DataFrame, as_of: Column, hours: int) -> DataFrame:
    return _recent(star, as_of, hours).where("event_key IS NOT NULL AND event_key <> ''")


def _signal(df: DataFrame, kind: str, subject: Column, severity: Column, confidence: Column, *key: Column) -> DataFrame:
    """key: the parts of the dedup key, joined by colons."""
    dedup = F.substring(F.concat_ws(":", *key), 1, 200)
    return df.select(F.lit(kind).alias("signal_type"), "country_code", subject.alias("subject"), severity.alias("severity"), F.round(confidence + 1e-9, 2).alias("confidence"), dedup.alias("dedup_key"), F.lit(TTL_HOURS[kind]).alias("ttl_h"))


def _of(kind: str, *more: Column) -> tuple[Column, ...]:
    return F.lit(kind), F.col("country_code"), *more


def _day(as_of: Column) -> Column:
    return F.date_format(as_of, "yyyyMMdd")


def tier_convergence(star: DataFrame, as_of: Column) -> DataFrame:
    """Events of a day in at least three tiers."""
    g = _keyed(star, as_of, 24).groupBy("country_code", "event_key").agg(F.countDistinct("tier").alias("tiers"), F.max("action_level").alias("al")).where("tiers >= 3")
    severity = F.when(F.coalesce("al", F.lit(1)) >= 4, "warning").otherwise("info")
    return _signal(g, "tier_convergence", F.col("event_key"), severity, F.least(F.lit(0.95), 0.5 + 0.1 * F.col("tiers")), *_of("tier_convergence", F.col("event_key")))


def official_silence(star: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """Events at least six hours old that loud tiers carry and quiet ones do not, where quiet ones have active sources."""
    count = lambda tiers: F.count(F.when(F.col("tier").isin(tiers), 1))
    g = _keyed(star, as_of, 24).groupBy("country_code", "event_key").agg(count(LOUD_TIERS).alias("loud"), count(QUIET_TIERS).alias("quiet"), F.min("published_at").alias("first"))
    g = g.where((F.col("loud") >= 3) & (F.col("quiet") == 0) & (F.col("first") < as_of - F.make_dt_interval(F.lit(0), F.lit(6))))
    g = g.join(sources.where(F.col("active") & F.col("tier").isin(QUIET_TIERS)).select("country_code").distinct(), "country_code", "left_semi")
    return _signal(g, "official_silence", F.col("event_key"), F.lit("warning"), F.least(F.lit(0.9), 0.55 + 0.05 * F.col("loud")), *_of("official_silence", F.col("event_key")))


def velocity_spike(star: DataFrame, as_of: Column) -> DataFrame:
    day = F.col("published_at") > as_of - F.make_dt_interval(F.lit(1))
    g = _recent(star, as_of, 720).groupBy("country_code").agg(F.count(F.when(day, 1)).alias("last"), F.count(F.when(~day, 1)).alias("old"))
    g = g.withColumn("base", F.greatest(F.col("old") / 29.0, F.lit(1.0))).where("last >= 5 AND last >= 1.5 * base").withColumn("ratio", F.col("last") / F.col("base"))
    return _signal(g, "velocity_spike", F.lit("volume"), F.when(F.col("ratio") >= 3, "warning").otherwise("info"), F.least(F.lit(0.9), 0.5 + 0.1 * F.col("ratio")), *_of("velocity_spike", _day(as_of)))


def _toned(gdelt: DataFrame, as_of: Column, least: int = 14) -> DataFrame:
    """Rows with a tone of the last 91 days, newest first by rn, of countries with at least `least` of them."""
    rows = gdelt.where((F.datediff(F.to_date(as_of), "day") < 91) & F.col("tone").isNotNull())
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("country_code").orderBy(F.desc("day"))))
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("country_code"))).where(F.col("n") >= least)


def tone_shift(gdelt: DataFrame, as_of: Column) -> DataFrame:
    base = F.when(F.col("rn") > 2, F.col("tone"))
    g = _toned(gdelt, as_of).groupBy("country_code").agg(F.max(F.when(F.col("rn") == 1, F.col("tone"))).alias("now"), F.avg(base).alias("m"), F.stddev_samp(base).alias("sd"))
    g = g.withColumn("z", (F.col("now") - F.col("m")) / F.greatest(F.col("sd"), F.lit(0.3))).where(F.abs("z") >= 1.6)
    return _signal(g, "tone_shift", F.lit("tone"), F.when(F.abs("z") >= 3, "critical").otherwise("warning"), F.least(F.lit(0.9), 0.5 + 0.1 * F.abs("z")), *_of("tone_shift", _day(as_of)))


def volume_surge(gdelt: DataFrame, as_of: Column) -> DataFrame:
    """A share of at least twice the mean of the third to thirty-second newest; the share's own nulls do not count."""
    rows = _toned(gdelt, as_of)
    newest = rows.groupBy("country_code").agg(F.max(F.when(F.col("rn") == 1, F.col("volume"))).alias("v"))
    shares = rows.where("share IS NOT NULL").withColumn("k", F.row_number().over(Window.partitionBy("country_code").orderBy("rn")))
    g = shares.groupBy("country_code").agg(F.count("*").alias("shares"), F.max(F.when(F.col("k") == 1, F.col("share"))).alias("now"), F.avg(F.when(F.col("k").between(3, 32), F.col("share"))).alias("m"))
    g = g.join(newest, "country_code").where("shares >= 14 AND m > 0 AND coalesce(v, 0) >= 10 AND now >= 2 * m")
    return _signal(g, "volume_surge", F.lit("share"), F.lit("warning"), F.lit(0.75), *_of("volume_surge", _day(as_of)))


def index_shift(deltas: DataFrame, as_of: Column) -> DataFrame:
    g = deltas.where(F.abs("delta_24h").between(7, 18))
    return _signal(g, "index_shift", F.lit("index"), F.when(F.abs("delta_24h") >= 14, "critical").otherwise("warning"), F.lit(0.8), *_of("index_shift", _day(as_of)))


def notable_event(articles: DataFrame, as_of: Column, demoted: tuple[str, ...] = (), most: int = 45) -> DataFrame:
    """One signal for each event key whatever its country: its strongest, most reprinted, newest article.

    Only articles whose title or body names the anchor count. At most 3 of a country (2 if demoted, which come last),
    `most` in all; demoted countries are never critical. articles: the star with title and body.
    """
    rows = _keyed(articles, as_of, 48).where((F.col("action_level") >= 4) & F.col("event_type").isin("diplomatic", "economic", "military", "security"))
    rows = rows.where(F.concat_ws(" ", "title", F.coalesce("body", F.lit(""))).rlike(f"(?iuU){ANCHOR}"))
    newest = [F.desc("action_level"), F.desc_nulls_last("reprint_count"), F.desc("published_at"), F.col("article_id")]
    best = rows.withColumn("k", F.row_number().over(Window.partitionBy("event_key").orderBy(*newest))).where("k = 1")
    best = best.withColumn("low", F.col("country_code").isin(*demoted) if demoted else F.lit(False))
    impact = [F.desc("action_level"), F.desc(F.coalesce("reprint_count", F.lit(0))), F.col("event_key")]
    place = F.row_number().over(Window.partitionBy("country_code").orderBy(*impact))
    top = best.withColumn("place", place).where(F.col("place") <= F.when(F.col("low"), 2).otherwise(3)).orderBy("low", *impact).limit(most)
    al = F.col("action_level")
    severity = F.when(F.col("low"), F.when(al >= 5, "warning").otherwise("info")).otherwise(F.when(al >= 6, "critical").when(al == 5, "warning").otherwise("info"))
    return _signal(top, "notable_event", F.col("event_key"), severity, F.least(F.lit(0.9), 0.55 + 0.07 * al), F.lit("notable"), F.col("event_key"))


def fx_move(rates: DataFrame, zones: DataFrame, live: DataFrame, as_of: Column) -> DataFrame:
    """Moves of two percent and more in the newest rate of the last three days, surer when a media signal came before.

    rates: currency, day, chg; zones: currency, country_code, place (the first is the signal's own); live: signals
    (signal_type, country_code, created_at), of which media ones of any country of the currency in the last 72 hours count.
    """
    rows = rates.where((F.datediff(F.to_date(as_of), "day") < 3) & F.col("chg").isNotNull())
    new = rows.groupBy("currency").agg(F.max_by(F.struct("day", "chg"), "day").alias("r")).select("currency", "r.*").where(F.abs("chg") >= 2)
    media = live.where(F.col("signal_type").isin("tone_shift", "volume_surge", "velocity_spike") & (F.col("created_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(72))))
    led = zones.join(media.select("country_code").distinct(), "country_code", "left_semi").select("currency", F.lit(True).alias("led")).distinct()
    first = zones.groupBy("currency").agg(F.min_by("country_code", "place").alias("country_code"))
    g = new.join(first, "currency", "left").join(led, "currency", "left")
    return _signal(g, "fx_move", F.col("currency"), F.when(F.abs("chg") >= 4, "warning").otherwise("info"), F.when(F.col("led"), 0.8).otherwise(0.65), F.lit("fx_move"), F.col("currency"), F.col("day").cast("string"))


def sanctions_escalation(pressure: DataFrame, registry: DataFrame, as_of: Column) -> DataFrame:
    """pressure: country_code, total, previous, updated_at; countries of the registry with at least 25 targets more."""
    g = pressure.withColumn("d", F.col("total") - F.col("previous")).where((F.col("d") >= 25) & (F.col("previous") > 0) & (F.col("updated_at") > as_of - F.make_dt_interval(F.lit(2))))
    g = g.join(registry.select("country_code").distinct(), "country_code", "left_semi")
    return _signal(g, "sanctions_escalation", F.lit("lists"), F.when(F.col("d") >= 100, "warning").otherwise("info"), F.lit(0.7), *_of("sanctions_escalation", F.date_format(as_of, "yyyyMM")))


def stored(signals: DataFrame, as_of: Column) -> DataFrame:
    """Signals as they are stored: with the times at which they came and at which they expire."""
    return signals.withColumn("created_at", as_of).withColumn("expires_at", as_of + F.make_dt_interval(F.lit(0), F.col("ttl_h")))


def clean_up(signals: DataFrame, as_of: Column, keep_days: int = 30) -> DataFrame:
    """signals without those that expired more than keep_days ago."""
    return signals.where(~(F.col("expires_at") < as_of - F.make_dt_interval(F.lit(keep_days))))


def suppress(new: DataFrame, live: DataFrame, as_of: Column) -> DataFrame:
    """New signals whose key is not alive, each key once."""
    alive = live.where(F.col("expires_at") > as_of).select("dedup_key").distinct()
    first = F.row_number().over(Window.partitionBy("dedup_key").orderBy(F.desc("confidence"), "country_code", "subject"))
    return new.join(alive, "dedup_key", "left_anti").withColumn("_k", first).where("_k = 1").drop("_k")

def suppress_history(events: DataFrame, ttl_s: int) -> DataFrame:
    """events (dedup_key, at_s long): which are emitted when each emission silences its key for ttl_s seconds.

    Depends on emissions before, so each key's times are gone through in order, by batches: a task holds one batch and
    for its key the last emission, however many events a key has.
    """
    times = events.select("dedup_key", "at_s").where("dedup_key IS NOT NULL AND at_s IS NOT NULL").distinct()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, 0
        for p in parts:
            keep = []
            for k, t in zip(p["dedup_key"], p["at_s"], strict=True):
                fresh = k != key or t >= last + ttl_s
                if fresh:
                    key, last = k, t
                keep.append(fresh)
            yield p[keep]

    return times.repartition("dedup_key").sortWithinPartitions("dedup_key", "at_s").mapInPandas(run, "dedup_key string, at_s long")
