"""Queries over the reports and their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports, threads
from .domain import AS_OF
from .engines import now, query

_OPEN = f"is_relevant AND NOT is_duplicate AND published_at > {AS_OF} - INTERVAL"
_STRONG = "action_level DESC NULLS LAST, reprint_count DESC NULLS LAST, published_at DESC, article_id"
_RANK = "action_level DESC NULLS LAST, published_at DESC, article_id"


@query("Q_headlines", f"SELECT article_id, country_code, tier FROM (SELECT *, country_code IN ('NATION_1', 'NATION_2') AS low, row_number() OVER (PARTITION BY source_id ORDER BY {_RANK}) AS a, row_number() OVER (PARTITION BY country_code ORDER BY {_RANK}) AS b FROM star WHERE {_OPEN} '72 hours') x WHERE a <= 2 AND b <= CASE WHEN low THEN 2 ELSE 4 END ORDER BY low, {_STRONG} LIMIT 60")
def headlines(v, t):
    return reports.headlines(v("star"), now(), 72, demoted=("NATION_1", "NATION_2"), most=60).select("article_id", "country_code", "tier")


@query("Q_headlines_country", f"SELECT article_id, tier FROM star WHERE {_OPEN} '720 hours' AND country_code = 'NATION_3' AND list_contains(topics, 'trade') ORDER BY {_STRONG} LIMIT 20")
def headlines_country(v, t):
    return reports.headlines(v("star"), now(), 720, country="NATION_3", topic="trade").select("article_id", "tier")


_FEED = f"FROM articles a JOIN sources s USING (source_id) JOIN titles d ON d.doc_id = a.article_id WHERE published_at >= {AS_OF} - INTERVAL '30 days' AND NOT is_backfill AND NOT is_duplicate AND contains(lower(d.text), 'the')"


@query("Q_article_feed", f"SELECT article_id, country_code, tier, (SELECT count(*) {_FEED}) AS total {_FEED} ORDER BY published_at DESC, article_id LIMIT 50 OFFSET 20")
def article_feed(v, t):
    d = v("titles").select(F.col("doc_id").alias("article_id"), "title", F.col("text").alias("body"))
    return reports.article_feed(v("articles").join(d, "article_id"), v("sources"), now(), 30, search="THE", most=50, skip=20).select("article_id", "country_code", "tier", "total")


@query("Q_entity_mentions", f"SELECT country_code, count(*) AS mentions, round(avg(CASE WHEN n.is_relevant THEN n.sentiment END), 2) AS mean, max(published_at) AS last_seen FROM notes n WHERE published_at > {AS_OF} - INTERVAL '20 days' AND (contains(lower(title), 'moscow') OR contains(lower(title), 'nowhere')) GROUP BY 1")
def mentions(v, t):
    return reports.entity_mentions(v("notes").select("article_id", "title", "country_code", "published_at"), v("analysis"), now(), ["Moscow", "nowhere"], 20)


@query("Q_crowd_insights", f"SELECT kind, name, count(*) AS n FROM (SELECT 'emotion' AS kind, emotion AS name FROM comments WHERE published_at >= {AS_OF} - INTERVAL '10 days' UNION ALL SELECT 'stance', stance FROM comments WHERE published_at >= {AS_OF} - INTERVAL '10 days' UNION ALL SELECT 'sentiment', CASE WHEN sentiment < -1.5 THEN 'very_negative' WHEN sentiment < -0.3 THEN 'negative' WHEN sentiment <= 0.3 THEN 'neutral' WHEN sentiment <= 1.5 THEN 'positive' ELSE 'very_positive' END FROM comments WHERE published_at >= {AS_OF} - INTERVAL '10 days') x WHERE name IS NOT NULL GROUP BY 1, 2")
def insights(v, t):
    return reports.crowd_insights(v("comments"), now(), 10)


@query("Q_thread_timelines", "SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY published_at, article_id) AS place, article_id, sentiment, coalesce(action_level, 1) AS action_level, event_type, tier FROM (SELECT DISTINCT thread_id, article_id FROM links) l JOIN articles a USING (article_id) LEFT JOIN analysis n USING (article_id) JOIN sources s USING (source_id)")
def timelines(v, t):
    return reports.thread_timelines(v("links"), v("articles"), v("analysis"), v("sources"))


@query("Q_country_cards", "SELECT n_name AS country_code, s[len(s)] AS score, array_to_string(s, ',') AS spark FROM nation LEFT JOIN (SELECT country_code, list(score ORDER BY day) AS s FROM (SELECT *, row_number() OVER (PARTITION BY country_code ORDER BY day DESC) AS rn FROM scores) x WHERE rn <= 7 GROUP BY 1) g ON g.country_code = n_name")
def cards(v, t):
    out = reports.country_cards(t("nation").select(F.col("n_name").alias("country_code")), v("scores"))
    return out.withColumn("spark", F.array_join(F.col("spark").cast("array<string>"), ","))


@query("Q_carousel", "SELECT * FROM (WITH d AS (SELECT country_code, temperature FROM temps WHERE day = DATE '2024-01-30'), h AS (SELECT * FROM d ORDER BY temperature DESC, country_code LIMIT 1), c AS (SELECT * FROM d WHERE country_code NOT IN (SELECT country_code FROM h) ORDER BY temperature, country_code LIMIT 1), m AS (SELECT * FROM d WHERE country_code NOT IN (SELECT country_code FROM h UNION ALL SELECT country_code FROM c) ORDER BY abs(temperature), country_code LIMIT 1) SELECT 'hot' AS what, * FROM h UNION ALL SELECT 'cold', * FROM c UNION ALL SELECT 'calm', * FROM m) x")
def carousel(v, t):
    return reports.carousel(v("temps"), F.lit("2024-01-30").cast("date"))


@query("A22_agreements", "SELECT event_key, arg_min(event_type, published_at) AS event_type, max(action_level) AS max_level, count(*) AS total, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY rn) FILTER (WHERE rn <= 5) AS newest FROM (SELECT story AS event_key, event_type, action_level, article_id, published_at, row_number() OVER (PARTITION BY story ORDER BY published_at DESC) AS rn FROM notes WHERE story IS NOT NULL AND event_type IN ('diplomatic', 'economic')) x GROUP BY 1")
def agreements(v, t):
    rows = v("notes").where("event_type IN ('diplomatic', 'economic')").select(F.col("story").alias("event_key"), "title", F.col("article_id").cast("string").alias("url"), F.col("tier").alias("source"), "published_at", "action_level", "event_type")
    out = threads.agreements(rows)
    return out.select("event_key", "event_type", "max_level", "total", F.array_join(F.transform("items", lambda i: i["url"]), ",").alias("newest"))
