"""Relations index: a structural layer, a media layer, event boosts, bounds, levels and deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
MEMBERSHIPS = {"union_state": 20, "csto": 25, "csto_suspended": 5, "eaeu": 15, "cis": 10, "sco": 5, "brics": 10, "nato": -25, "eu": -15, "g7": -5}
UNFRIENDLY, SANCTIONS, WAR = -10, -20, -60
LEVELS = [(45, "ally"), (15, "partner"), (-15, "neutral"), (-40, "cooling"), (-70, "tension")]
TIER_1, TIER_2 = (0.45, 0.55), (0.60, 0.40)
TONE_SCALE = 12.0


def clamp(c: Column, lo: float = -100.0, hi: float = 100.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def structural(countries: DataFrame, votes: DataFrame, year: int) -> DataFrame:
    """countries: country_code, memberships, unfriendly, sanctions, war, adjustment, tier1. Adds structural."""
    w = F.create_map(*[F.lit(x) for k, v in MEMBERSHIPS.items() for x in (k, v)])
    members = F.aggregate("memberships", F.lit(0), lambda s, m: s + F.coalesce(F.element_at(w, m), F.lit(0)))
    un = votes.where(F.col("year") >= year - 3).groupBy("country_code").agg(F.avg("agreement_pct").alias("pct"))
    un = un.select("country_code", F.round((F.col("pct") - 50) / 50 * 15 + 1e-9, 1).alias("un"))
    flag = lambda c, v: F.when(F.col(c), v).otherwise(0)
    total = members + flag("unfriendly", UNFRIENDLY) + flag("sanctions", SANCTIONS) + flag("war", WAR) + F.coalesce("adjustment", F.lit(0)) + F.coalesce("un", F.lit(0.0))
    return countries.join(un, "country_code", "left").withColumn("structural", clamp(total.cast("double"))).drop("un")


def media(temps: DataFrame, gdelt: DataFrame, as_of_day: Column) -> DataFrame:
    """Latest temperature of the last two days, else the decayed tone of a week, scaled."""
    own = temps.where(F.datediff(as_of_day, "day") <= 2).groupBy("country_code").agg(F.max_by("temperature", "day").alias("own"))
    i = F.row_number().over(Window.partitionBy("country_code").orderBy(F.desc("day"))) - 1
    tones = gdelt.where((F.datediff(as_of_day, "day") < 8) & F.col("tone").isNotNull()).withColumn("k", F.pow(F.lit(0.8), i))
    tones = tones.groupBy("country_code").agg(clamp(F.sum(F.col("tone") * F.col("k")) / F.sum("k") * TONE_SCALE).alias("world"))
    return own.join(tones, "country_code", "full").select("country_code", F.coalesce("own", "world").alias("media"))


def boost(star: DataFrame, as_of: Column) -> DataFrame:
    rows = star.where((F.col("action_level") >= 5) & F.col("is_relevant") & ~F.col("is_backfill") & F.col("sentiment").isNotNull() & (F.col("published_at") > as_of - F.make_dt_interval(F.lit(14))))
    n = rows.groupBy("country_code", "sentiment", "action_level").count()
    return n.groupBy("country_code").agg(clamp(F.sum(F.signum("sentiment") * 5 * F.least("count", F.lit(2))), -15.0, 15.0).alias("boost"))


def level(score: Column) -> Column:
    out = F.lit("hostile")
    for least, name in reversed(LEVELS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def index(countries: DataFrame, votes: DataFrame, temps: DataFrame, gdelt: DataFrame, star: DataFrame, as_of: Column, year: int) -> DataFrame:
    """(country_code, structural, media, boost, score, level)"""
    s = structural(countries, votes, year)
    both = s.join(media(temps, gdelt, F.to_date(as_of)), "country_code", "left").join(boost(star, as_of), "country_code", "left").fillna({"boost": 0.0})
    mixed = F.when(F.col("tier1"), F.col("structural") * TIER_1[0] + F.col("media") * TIER_1[1]).otherwise(F.col("structural") * TIER_2[0] + F.col("media") * TIER_2[1])
    score = clamp(F.when(F.col("media").isNull(), F.col("structural")).otherwise(mixed + F.col("boost")))
    score = F.when(F.col("war"), F.least(score, F.lit(-75.0))).otherwise(score)
    score = F.when(F.col("sanctions") & F.col("unfriendly"), F.least(score, F.lit(-5.0))).otherwise(score)
    has = lambda m: F.array_contains("memberships", m)
    score = F.when(has("union_state"), F.greatest(score, F.lit(25.0))).when(has("csto"), F.greatest(score, F.lit(-25.0))).otherwise(score)
    out = both.withColumn("score", F.round(score + 1e-9, 2))
    return out.select("country_code", "structural", F.round(F.col("media") + 1e-9, 2).alias("media"), "boost", "score", level(F.col("score")).alias("level"))


def deltas(current: DataFrame, history: DataFrame, as_of: Column) -> DataFrame:
    """Change against the newest reading of at least three quarters of a day, and of a week, within eight days."""
    age = (F.unix_micros(as_of) - F.unix_micros(F.col("day").cast("timestamp"))) / 3.6e9
    old = history.withColumn("age", age).where("age <= 192").groupBy("country_code").agg(
        F.max_by("score", F.when(F.col("age") >= 18, F.col("day"))).alias("d1"), F.max_by("score", F.when(F.col("age") >= 126, F.col("day"))).alias("d7")
    )
    diff = lambda c: F.round(F.col("score") - F.col(c) + 1e-9, 2)
    return current.join(old, "country_code", "left").select("country_code", "score", diff("d1").alias("delta_24h"), diff("d7").alias("delta_7d"))
