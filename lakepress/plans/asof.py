"""As-of lookups, all by the one operator; the oracle uses its engine's own as-of join."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.asof import asof_join
from .engines import query


@query("J16_asof_previous", "SELECT f.currency, f.day, f.rate, p.day AS previous_day, p.rate AS previous FROM fx f ASOF LEFT JOIN fx p ON f.currency = p.currency AND f.day > p.day")
def j16(v, t):
    """The rate strictly before each day's."""
    return asof_join(v("fx"), v("fx").select("currency", F.col("day").alias("previous_day"), F.col("rate").alias("previous")), ["currency"], "day", "previous_day", ["previous"], strict=True)


@query("J17_asof_30_days", "SELECT f.currency, f.day, f.rate, p.day AS then_day, p.rate AS rate_then FROM (SELECT *, CAST(day - 30 AS DATE) AS want FROM fx) f ASOF LEFT JOIN fx p ON f.currency = p.currency AND f.want >= p.day")
def j17(v, t):
    """The last rate at or before the day thirty days ago."""
    then = v("fx").select("currency", F.col("day").alias("then_day"), F.col("rate").alias("rate_then"))
    return asof_join(v("fx").withColumn("want", F.date_sub("day", 30)), then, ["currency"], "want", "then_day", ["rate_then"]).drop("want")


@query("J18_asof_point", "SELECT s.country_code, s.day, s.score, p.day AS then_day, p.score AS score_then FROM (SELECT *, CAST(day - 6 AS DATE) AS want FROM scores) s LEFT JOIN (SELECT a.country_code AS c, a.day AS d, b.day, b.score FROM scores a ASOF JOIN scores b ON a.country_code = b.country_code AND a.day - 6 >= b.day) p ON s.country_code = c AND s.day = d AND s.want - p.day <= 2")
def j18(v, t):
    """The score of a week ago: the last one that is at least six days old, and at most eight."""
    then = v("scores").select("country_code", F.col("day").alias("then_day"), F.col("score").alias("score_then"))
    out = asof_join(v("scores").withColumn("want", F.date_sub("day", 6)), then, ["country_code"], "want", "then_day", ["score_then"], within=lambda a, b: F.date_diff(a, b) <= 2)
    return out.drop("want")


@query("J19_asof_media", "SELECT c.comment_id, t.day AS media_day, t.temperature AS media FROM (SELECT comment_id, country_code, CAST(published_at AS DATE) AS said FROM comments) c ASOF LEFT JOIN temps t ON c.country_code = t.country_code AND c.said >= t.day")
def j19(v, t):
    """To each comment the media temperature of its country as it was known that day."""
    said = v("comments").select("comment_id", "country_code", F.to_date("published_at").alias("said"))
    media = v("temps").select("country_code", F.col("day").alias("media_day"), F.col("temperature").alias("media"))
    return asof_join(said, media, ["country_code"], "said", "media_day", ["media"]).select("comment_id", "media_day", "media")
