"""Feeds and reports with parameters: headlines, article feed, mentions, insights, timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _within(as_of: Column, hours: int) -> Column:
    return F.col("published_at") > as_of - F.make_dt_interval(F.lit(0), F.lit(hours))


def headlines(star: DataFrame, as_of: Column, hours: int = 24, tier: str | None = None, country: str | None = None, countries: list[str] | None = None, topic: str | None = None, demoted: tuple[str, ...] = (), most: int = 20) -> DataFrame:
    """Relevant articles that are no duplicates, strongest first.

    One country's view has no caps. Else at most two articles of a source and four of a country (two if demoted), and
    demoted countries come last. countries: those of a region.
    """
    rows = star.where(F.col("is_relevant") & ~F.col("is_duplicate") & _within(as_of, hours))
    for value, name in ((tier, "tier"), (country, "country_code")):
        rows = rows if value is None else rows.where(F.col(name) == value)
    rows = rows if countries is None else rows.where(F.col("country_code").isin(countries))
    rows = rows if topic is None else rows.where(F.array_contains("topics", topic))
    strong = [F.desc_nulls_last("action_level"), F.desc_nulls_last("reprint_count"), F.desc("published_at"), F.col("article_id")]
    if country is not None:
        return rows.orderBy(*strong).limit(most)
    low = F.col("country_code").isin(*demoted) if demoted else F.lit(False)
    rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(F.desc_nulls_last("action_level"), F.desc("published_at"), "article_id"))
    rows = rows.withColumn("src_rank", rank("source_id")).withColumn("cc_rank", rank("country_code")).withColumn("low", low)
    capped = rows.where((F.col("src_rank") <= 2) & (F.col("cc_rank") <= F.when(F.col("low"), 2).otherwise(4)))
    return capped.orderBy("low", *strong).limit(most).drop("src_rank", "cc_rank", "low")


def article_feed(articles: DataFrame, sources: DataFrame, as_of: Column, days: int = 3, country: str | None = None, source_id: int | None = None, search: str | None = None, most: int = 50, skip: int = 0) -> DataFrame:
    """A page of the live feed, newest first, with the number of all that match; search is in title or body, whatever its case."""
    rows = articles.where((F.col("published_at") >= as_of - F.make_dt_interval(F.lit(days))) & ~F.col("is_backfill") & ~F.col("is_duplicate"))
    rows = rows if source_id is None else rows.where(F.col("source_id") == source_id)
    if search is not None:
        rows = rows.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit(search.lower())) | F.contains(F.lower(F.coalesce("body", F.lit(""))), F.lit(search.lower())))
    of = sources if country is None else sources.where(F.col("country_code") == country)
    rows = rows.join(of.select("source_id", "country_code", "tier"), "source_id")
    total = rows.agg(F.count("*").alias("total")).withColumn("_one", F.lit(1))
    page = rows.orderBy(F.desc("published_at"), "article_id").offset(skip).limit(most).withColumn("_one", F.lit(1))
    return page.join(F.broadcast(total), "_one").drop("_one")


def entity_mentions(articles: DataFrame, analysis: DataFrame, as_of: Column, aliases: list[str], days: int = 30) -> DataFrame:
    """Per country: articles whose title names an alias, mean sentiment of the relevant ones, last time.

    articles: article_id, title, country_code, published_at; analysis: article_id, is_relevant, sentiment.
    """
    low, hit = F.lower("title"), F.lit(False)
    for a in aliases:
        hit = hit | F.contains(low, F.lit(a.lower()))
    rows = articles.where(hit & _within(as_of, 24 * days)).join(analysis.where("is_relevant").select("article_id", "sentiment"), "article_id", "left")
    return rows.groupBy("country_code").agg(F.count("*").alias("mentions"), F.round(F.avg("sentiment") + 1e-9, 2).alias("mean"), F.max("published_at").alias("last_seen"))


def crowd_insights(comments: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """(kind, name, n): how many comments have each emotion, stance and sentiment bucket; the three are counted in one pass."""
    s = F.col("sentiment")
    bucket = F.when(s < -1.5, "very_negative").when(s < -0.3, "negative").when(s <= 0.3, "neutral").when(s <= 1.5, "positive").when(s.isNotNull(), "very_positive")
    said = F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("name")) for k, c in (("emotion", F.col("emotion")), ("stance", F.col("stance")), ("sentiment", bucket))])
    rows = comments.where(F.col("published_at") >= as_of - F.make_dt_interval(F.lit(days))).select(F.explode(said).alias("x")).select("x.*")
    return rows.where("name IS NOT NULL").groupBy("kind", "name").agg(F.count("*").alias("n"))


def thread_timelines(links: DataFrame, articles: DataFrame, analysis: DataFrame, sources: DataFrame, thread_id: int | None = None) -> DataFrame:
    """(thread_id, place, article_id, ...): each thread's articles in order of time, or those of one thread."""
    own = links if thread_id is None else links.where(F.col("thread_id") == thread_id)
    rows = own.select("thread_id", "article_id").distinct().join(articles.select("article_id", "source_id", "published_at"), "article_id").join(analysis.select("article_id", "sentiment", "action_level", "event_type"), "article_id", "left").join(sources.select("source_id", "tier"), "source_id")
    place = F.row_number().over(Window.partitionBy("thread_id").orderBy("published_at", "article_id"))
    return rows.select("thread_id", place.alias("place"), "article_id", "sentiment", F.coalesce("action_level", F.lit(1)).alias("action_level"), "event_type", "tier")


def country_cards(countries: DataFrame, scores: DataFrame, points: int = 7) -> DataFrame:
    """(country_code, score, spark): each country's newest score, null without any, and its last `points` scores, oldest first."""
    rn = F.row_number().over(Window.partitionBy("country_code").orderBy(F.desc("day")))
    last = scores.withColumn("rn", rn).where(F.col("rn") <= points)
    g = last.groupBy("country_code").agg(F.max_by("score", "day").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct("day", "score"))), lambda s: s["score"]).alias("spark"))
    return countries.select("country_code").join(g, "country_code", "left")


def carousel(temps: DataFrame, day: Column) -> DataFrame:
    """(what, country_code, temperature): the hottest, then the coldest and the one nearest to zero among countries not used yet."""
    rows = temps.where(F.col("day") == day).select("country_code", "temperature")
    hot = rows.orderBy(F.desc("temperature"), "country_code").limit(1)
    rest = rows.join(F.broadcast(hot.select("country_code")), "country_code", "left_anti")
    cold = rest.orderBy("temperature", "country_code").limit(1)
    calm = rest.join(F.broadcast(cold.select("country_code")), "country_code", "left_anti").orderBy(F.abs("temperature"), "country_code").limit(1)
    parts = [p.select(F.lit(k).alias("what"), "country_code", "temperature") for k, p in (("hot", hot), ("cold", cold), ("calm", calm))]
    return parts[0].union(parts[1]).union(parts[2])
