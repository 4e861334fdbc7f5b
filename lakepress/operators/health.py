"""Source freshness: learned cadence, state, group and country summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hours(a: Column, b: Column) -> Column:
    return (F.unix_micros(a) - F.unix_micros(b)) / 3.6e9


def source_health(sources: DataFrame, articles: DataFrame, as_of: Column) -> DataFrame:
    """(source_id, country_code, tier, cadence_h, expected_h, silent_h, state) for active sources."""
    w = Window.partitionBy("source_id").orderBy("published_at", "article_id")
    recent = articles.where(F.col("published_at") > as_of - F.make_dt_interval(F.lit(30)))
    gaps = recent.withColumn("gap", hours(F.col("published_at"), F.lag("published_at").over(w))).where("gap > 0").groupBy("source_id").agg(F.percentile("gap", 0.5).alias("cadence"))
    last = articles.groupBy("source_id").agg(F.max("published_at").alias("last"))
    out = sources.where("active").join(gaps, "source_id", "left").join(last, "source_id", "left")
    expected = F.when(F.col("cadence").isNull(), 72.0).otherwise(F.greatest(F.lit(2.0), F.least(F.lit(72.0), 3 * F.col("cadence"))))
    out = out.withColumn("expected", expected).withColumn("silent", hours(as_of, F.col("last")))
    state = F.when(F.col("last").isNull() | (F.col("silent") > 168), "DEAD").when(F.col("silent") > F.col("expected"), "STALE").otherwise("OK")
    r = lambda c: F.round(F.col(c) + 1e-9, 4)
    return out.select("source_id", "country_code", "tier", r("cadence").alias("cadence_h"), r("expected").alias("expected_h"), r("silent").alias("silent_h"), state.alias("state"))


def group_freshness(table: DataFrame, fetched: str, as_of: Column) -> DataFrame:
    g = table.agg(F.max(fetched).alias("last"), F.countDistinct(F.when(F.datediff(as_of, fetched) < 3, F.col("country_code"))).alias("countries"))
    age = hours(as_of, F.col("last"))
    return g.select(F.when(F.col("last").isNull(), "DEAD").when(age <= 26, "OK").otherwise("STALE").alias("state"), "countries")


def health_summary(health: DataFrame) -> DataFrame:
    """(country_code, ok, stale, dead, coverage, dark_tiers) for each country."""
    count = lambda s: F.count(F.when(F.col("state") == s, 1))
    tiers = health.groupBy("country_code", "tier").agg(count("OK").alias("ok")).groupBy("country_code").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("ok") == 0, F.col("tier")))), ",").alias("dark_tiers"))
    out = health.groupBy("country_code").agg(count("OK").alias("ok"), count("STALE").alias("stale"), count("DEAD").alias("dead"), F.count("*").alias("n"))
    return out.join(tiers, "country_code").select("country_code", "ok", "stale", "dead", F.round(100.0 * F.col("ok") / F.col("n") + 1e-9, 1).alias("coverage"), "dark_tiers")


def overall_verdict(health: DataFrame, news: DataFrame) -> DataFrame:
    """One row (sources, ok, stale, dead, coverage, verdict); news (state): whether the news feed is fresh, which HEALTHY needs."""
    count = lambda s: F.count(F.when(F.col("state") == s, 1))
    g = health.agg(F.count("*").alias("sources"), count("OK").alias("ok"), count("STALE").alias("stale"), count("DEAD").alias("dead"))
    fresh = news.agg(F.max(F.col("state") == "OK").alias("fresh"))  # one row, like the other
    cover = F.when(F.col("sources") > 0, 100.0 * F.col("ok") / F.col("sources")).otherwise(0.0)
    verdict = F.when(F.col("sources") == 0, "UNHEALTHY").when((cover >= 80) & F.col("fresh"), "HEALTHY").when(cover >= 60, "WARNING").when(cover >= 40, "DEGRADED").otherwise("UNHEALTHY")
    both = g.withColumn("_one", F.lit(1)).join(fresh.withColumn("_one", F.lit(1)), "_one")
    return both.select("sources", "ok", "stale", "dead", F.round(cover + 1e-9, 1).alias("coverage"), verdict.alias("verdict"))


def failure_runs(fetches: DataFrame) -> DataFrame:
    """fetches (source_id, at, status): failures since the last ok, and quarantine from the fifth on."""
    w = Window.partitionBy("source_id").orderBy("at")
    runs = fetches.withColumn("run", F.sum((F.col("status") == "ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    fails = F.sum((F.col("status") != "ok").cast("int")).over(Window.partitionBy("source_id", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("failures", fails).withColumn("quarantined", F.col("failures") >= 5).drop("run")
