"""Decayed, cluster-discounted sentiment temperature, its trend and anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ACTION = {1: 1, 2: 3, 3: 5, 4: 8, 5: 12, 6: 15}
EVENT_TYPE = {"military": 1.5, "diplomatic": 1.3, "security": 1.2, "economic": 1.0, "cultural": 0.8}
TAU_S = 1209600.0
REPEAT = 0.2


def lookup(table: dict, c: Column, default: float = 1.0) -> Column:
    m = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v))])
    return F.coalesce(F.element_at(m, c), F.lit(default))


def age_seconds(ts: Column, at: Column) -> Column:
    return (F.unix_micros(at) - F.unix_micros(ts)) / 1e6


def weighted(star: DataFrame, as_of: Column, days: int = 14, extra_keys: tuple[str, ...] = (), include_backfill: bool = False) -> DataFrame:
    """star's live rows of the window with c, the share of a repeated event, and w, the full weight."""
    rows = star.where(F.col("is_relevant") & F.col("sentiment").isNotNull() & (F.col("published_at") > as_of - F.make_dt_interval(F.lit(days))))
    if not include_backfill:
        rows = rows.where(~F.col("is_backfill"))
    key = F.lower(F.trim("event_key"))
    cluster = F.when(F.length("event_key") > 3, F.concat(F.lit("e:"), key)).otherwise(F.concat(F.lit("a:"), F.col("article_id").cast("string")))
    base = F.when(F.col("weight").isNull() | (F.col("weight") == 0), 1.0).otherwise(F.col("weight"))
    place = F.row_number().over(Window.partitionBy("country_code", *extra_keys, cluster).orderBy(F.desc(base), "article_id"))
    w = base * lookup(EVENT_TYPE, F.col("event_type")) * F.exp(-age_seconds(F.col("published_at"), as_of) / TAU_S) * (1 + F.log1p("reprint_count")) * lookup(ACTION, F.col("action_level").cast("int"))
    return rows.withColumn("c", F.pow(F.lit(REPEAT), place - 1)).withColumn("w", w * F.col("c"))


def temperature(star: DataFrame, as_of: Column, days: int = 14, keys: tuple[str, ...] = (), **how) -> DataFrame:
    """One row per country (and further keys): temperature, raw_sentiment, components by event type, counts."""
    rows = weighted(star, as_of, days, keys, **how)
    raw = F.sum(F.col("sentiment") * F.col("w")) / F.nullif(F.sum(F.abs("w")), F.lit(0.0))
    parts = [
        F.round(F.sum(F.when(F.col("event_type") == t, F.col("sentiment") * F.col("c"))) / F.nullif(F.sum(F.when(F.col("event_type") == t, F.col("c"))), F.lit(0.0)) + 1e-9, 2).alias(t)
        for t in EVENT_TYPE
    ]
    return rows.groupBy("country_code", *keys).agg(
        F.round(raw * 100 / 3 + 1e-9, 1).alias("temperature"), F.round(raw + 1e-9, 2).alias("raw_sentiment"), *parts, F.count("*").alias("n_articles"), F.countDistinct("source_id").alias("n_sources")
    )


def historical_temperature(star: DataFrame, days_: DataFrame, window: int = 14, least: int = 1) -> DataFrame:
    """Temperature as of the end of each day of days_ (day), all days in one job; backfilled rows count, being of that time."""
    need = ["country_code", "article_id", "source_id", "sentiment", "event_type", "event_key", "action_level", "reprint_count", "weight", "published_at", "is_relevant", "is_backfill"]
    # midnight belongs to the day before; each row counts for the window's days after its own: the join stays an equal one
    by_day = star.select(*need, F.to_date(F.col("published_at") - F.expr("INTERVAL 1 MICROSECOND")).alias("own"))
    spread = by_day.withColumn("day", F.explode(F.sequence(F.col("own"), F.date_add("own", window)))).drop("own")
    rows = spread.join(F.broadcast(days_.select("day").distinct()), "day")  # one row a day
    as_of = F.date_add("day", 1).cast("timestamp")
    return temperature(rows, as_of, window, ("day",), include_backfill=True).where(F.col("n_articles") >= least)


def trend(history: DataFrame) -> DataFrame:
    """rising or falling when a reading is over 5 away from the mean of up to three before it (two at least)."""
    before = Window.partitionBy("country_code").orderBy("day").rowsBetween(-3, -1)
    d = F.col("temperature") - F.avg("temperature").over(before)
    n = F.count("temperature").over(before)
    return history.withColumn("trend", F.when(n < 2, "stable").when(d > 5, "rising").when(d < -5, "falling").otherwise("stable"))


def anomaly(history: DataFrame, least: int = 5) -> DataFrame:
    """z against up to thirty readings before; alert beyond 2, critical beyond 3."""
    before = Window.partitionBy("country_code").orderBy("day").rowsBetween(-30, -1)
    sd = F.coalesce(F.nullif(F.stddev_samp("temperature").over(before), F.lit(0.0)), F.lit(1.0))
    z = F.when(F.count("temperature").over(before) >= least, F.round((F.col("temperature") - F.avg("temperature").over(before)) / sd + 1e-9, 2))
    return history.withColumn("z", z).withColumn("alert", F.when(F.abs("z") > 3, "critical").when(F.abs("z") > 2, "warning"))
