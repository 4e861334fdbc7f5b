"""Domain views over the driver's tables, as SQL that Spark and the oracle both read.

A query is a body over these views; only the views that it names are put in front of it, and Catalyst inlines them,
so filters and column choices reach the Parquet scans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Dialect:
    """What the two engines write differently."""

    spark: bool

    @property
    def string(self) -> str:
        return "STRING" if self.spark else "VARCHAR"

    def us(self, x: str) -> str:
        return f"unix_micros({x})" if self.spark else f"epoch_us({x})"

    def age_s(self, x: str, at: str = AS_OF) -> str:
        return f"(CAST({self.us(at)} - {self.us(x)} AS DOUBLE) / CAST(1000000 AS DOUBLE))"

    def set_join(self, x: str, where: str = "TRUE") -> str:
        return f"array_join(sort_array(collect_set(CASE WHEN {where} THEN CAST({x} AS STRING) END)), ',')" if self.spark else f"coalesce(array_to_string(list_sort(list(DISTINCT CAST({x} AS VARCHAR)) FILTER (WHERE {where} AND {x} IS NOT NULL)), ','), '')"

    def list_join(self, x: str, *order: str) -> str:
        """Values in ascending order of the keys, which must be unique; nulls as '-'."""
        if self.spark:
            return f"array_join(transform(sort_array(collect_list(struct({', '.join(f'{o} AS o{i}' for i, o in enumerate(order))}, coalesce(CAST({x} AS STRING), '-') AS v))), s -> s.v), ',')"
        return f"array_to_string(list(coalesce(CAST({x} AS VARCHAR), '-') ORDER BY {', '.join(order)}), ',')"

    def unnest(self, table: str, array: str, name: str) -> str:
        return f"{table} LATERAL VIEW explode({array}) u_ AS {name}" if self.spark else f"{table}, unnest({array}) u_({name})"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})" if self.spark else f"[{', '.join(x)}]"

    def has(self, array: str, x: str) -> str:
        return f"array_contains({array}, {x})" if self.spark else f"list_contains({array}, {x})"

    def match(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def sub(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')" if self.spark else f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def days(self, n: int) -> str:
        return f"INTERVAL {n} DAY" if self.spark else f"INTERVAL '{n} days'"

    def hours(self, n: int) -> str:
        return f"INTERVAL {n} HOUR" if self.spark else f"INTERVAL '{n} hours'"

    def median(self, x: str) -> str:
        return f"percentile({x}, 0.5)" if self.spark else f"quantile_cont({x}, 0.5)"

    def day_diff(self, a: str, b: str) -> str:
        return f"datediff({a}, {b})" if self.spark else f"date_diff('day', {b}, {a})"

    def first_line(self, x: str) -> str:
        return f"substring_index({x}, '\\n', 1)" if self.spark else f"split_part({x}, chr(10), 1)"

    def vector(self) -> str:
        """Vectors of one label lie close together: the label's places are lifted, the others shrunk."""
        return "transform(embedding, (x, i) -> CAST(x AS DOUBLE) * 0.35D + CASE WHEN i % 10 = label THEN 0.25D ELSE 0D END)" if self.spark else "list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * 0.35 + CASE WHEN (i - 1) % 10 = label THEN 0.25 ELSE 0 END)"

    def arg_max(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})" if self.spark else f"arg_max({x}, {by})"


SPARK, DUCK = Dialect(True), Dialect(False)


def views(d: Dialect) -> dict[str, str]:
    s = d.string
    mix = "CAST(floor(((event_id * {a} + user_id * {b}) % 4294967296) / 65536) AS BIGINT)"
    return {
        "mix": f"SELECT event_id, user_id, event_type, value, CAST(ts AS TIMESTAMP) AS ts, {mix.format(a=2654435761, b=40503)} AS h1, {mix.format(a=2246822519, b=3266489)} AS h2 FROM events",
        "tiers": "SELECT * FROM (VALUES (0,'official'),(1,'mainstream'),(2,'independent'),(3,'social'),(4,'domestic_opposition'),(5,'western_proxy'),(6,'analytics')) t(k, tier)",
        "sources": "SELECT CAST(n_nationkey * 7 + k AS BIGINT) AS source_id, n_name AS country_code, tier, CAST(1 + k % 4 AS DOUBLE) / 2 AS weight, (n_nationkey * 7 + k) % 11 <> 10 AS active, CASE WHEN (n_nationkey + k) % 3 = 0 THEN 'ru' WHEN (n_nationkey + k) % 3 = 1 THEN 'en' ELSE 'native' END AS language FROM nation CROSS JOIN tiers",
        "articles": "SELECT event_id AS article_id, h1 % 175 AS source_id, ts AS published_at, h2 % 5 AS reprint_count, event_id % 20 = 0 AS is_backfill, event_id % 17 = 0 AS is_duplicate, user_id FROM mix",
        "analysis": f"""SELECT event_id AS article_id, h2 % 4 <> 3 AS is_relevant, CASE WHEN h1 % 50 = 0 THEN NULL ELSE CAST(h2 % 61 - 30 AS DOUBLE) / CAST(10 AS DOUBLE) END AS sentiment,
  CASE event_type WHEN 'view' THEN 'diplomatic' WHEN 'click' THEN 'military' WHEN 'purchase' THEN 'economic' WHEN 'signup' THEN 'cultural' ELSE 'security' END AS event_type,
  1 + h1 % 6 AS action_level, CASE WHEN h2 % 9 = 0 THEN NULL ELSE concat('event-', CAST(user_id % 3 AS {s})) END AS event_key,
  CASE WHEN h2 % 3 = 0 THEN {d.array("'energy'", "'trade'")} WHEN h2 % 3 = 1 THEN {d.array("'defence'")} ELSE {d.array("'trade'", "'sport'", "'culture'")} END AS topics FROM mix WHERE event_id % 13 <> 12""",
        "star": "SELECT s.country_code, s.source_id, s.tier, s.weight, s.language, a.article_id, a.is_relevant, a.sentiment, a.event_type, a.action_level, a.event_key, a.topics, ar.published_at, ar.reprint_count, ar.is_backfill, ar.is_duplicate FROM analysis a JOIN articles ar ON a.article_id = ar.article_id JOIN sources s ON ar.source_id = s.source_id",
        "gdelt": "SELECT day, country_code, volume, CAST(volume AS DOUBLE) / CAST(sum(volume) OVER (PARTITION BY day) AS DOUBLE) AS share, tone FROM (SELECT CAST(published_at AS DATE) AS day, country_code, count(*) AS volume, round(avg(sentiment) * 3, 4) AS tone FROM star GROUP BY 1, 2) g",
        "temps": "SELECT CAST(published_at AS DATE) AS day, country_code, round(avg(sentiment) * 100 / 3, 1) AS temperature, count(*) AS n FROM star WHERE is_relevant AND sentiment IS NOT NULL GROUP BY 1, 2",
        "scores": "SELECT day, country_code, round(temperature * CAST(2 AS DOUBLE), 2) AS score FROM temps",
        "fx": "SELECT CAST(o_orderdate AS DATE) AS day, n_name AS currency, round(avg(o_totalprice), 2) AS rate FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
        "un_votes": "SELECT n_name AS country_code, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS total, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS agree, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS disagree FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
        "trade": "SELECT n_name AS country_code, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS exports, CAST(sum(CASE WHEN l_returnflag <> 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS imports FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2",
        "comments": f"""SELECT conv_id * 1000 + turn AS comment_id, conv_id, turn, text, n_name AS country_code, CASE WHEN conv_id % 2 = 0 THEN 'telegram' ELSE 'youtube' END AS platform, CAST(conv_id % 7 AS {s}) AS channel_id_ext,
  CAST((conv_id * 7 + turn * 3) % 61 - 30 AS DOUBLE) / CAST(10 AS DOUBLE) AS sentiment, CAST((conv_id * 13 + turn) % 10 AS DOUBLE) / CAST(10 AS DOUBLE) AS bot_score,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'anger' WHEN 1 THEN 'joy' WHEN 2 THEN 'fear' ELSE 'irony' END AS emotion, CASE (conv_id * 3 + turn) % 3 WHEN 0 THEN 'pro' WHEN 1 THEN 'anti' ELSE 'neutral' END AS stance,
  {AS_OF} - ((conv_id * 37 + turn * 11) % 400) * {d.hours(1)} AS published_at, 'c' AS one FROM conversations JOIN nation ON n_nationkey = conv_id % 25""",
        "channels": f"SELECT CAST(k AS BIGINT) AS channel_id, tier AS name, CASE WHEN k % 2 = 0 THEN 'telegram' ELSE 'youtube' END AS platform FROM tiers",
        "views_": "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, CAST(ts AS DATE) AS day, event_type AS path, user_id AS visitor FROM events",
        "usage_": "SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, event_type AS script, CASE WHEN user_id % 2 = 0 THEN 'alpha-large-2' ELSE 'beta' END AS model, CAST(event_id % 1000 AS BIGINT) AS tokens_in, CAST(event_id % 300 AS BIGINT) AS tokens_out FROM events",
        "threads": "SELECT country_code, event_key AS thread_key, min(article_id) AS thread_id, count(*) AS article_count, min(published_at) AS first_seen, max(published_at) AS last_seen, avg(sentiment) AS avg_sentiment, max(action_level) AS max_action_level, count(DISTINCT source_id) AS n_sources, count(DISTINCT tier) AS n_tiers FROM star WHERE event_key IS NOT NULL AND is_relevant GROUP BY 1, 2",
        "links": "SELECT t.thread_id, s.article_id, t.country_code FROM star s JOIN threads t ON s.country_code = t.country_code AND s.event_key = t.thread_key WHERE s.is_relevant UNION ALL SELECT t.thread_id, s.article_id, t.country_code FROM star s JOIN threads t ON s.country_code = t.country_code WHERE s.article_id % 29 = 0",
        "daily": "SELECT g.day, g.country_code, CASE WHEN g.day = m.day AND n_nationkey % 3 = 0 THEN g.volume * 6 ELSE g.volume END AS volume, CASE WHEN g.day = m.day AND n_nationkey % 3 = 0 THEN g.share * 6 ELSE g.share END AS share, CASE WHEN n_nationkey % 7 = 5 AND g.volume % 5 = 0 THEN NULL ELSE g.tone END AS tone FROM gdelt g JOIN (SELECT max(day) AS day FROM gdelt) m ON g.day <= m.day JOIN nation ON n_name = g.country_code",
        "notes": "SELECT s.*, CASE WHEN event_key IS NOT NULL THEN concat(event_key, '-', source_id) END AS story, CASE WHEN article_id % 4 = 0 THEN 'Court news of the town' ELSE 'Talks in Moscow' END AS title, CASE WHEN article_id % 8 = 0 THEN 'A minister of RUSSIA came' END AS body FROM star s",
        "pairs_": "SELECT p.source_id, s.country_code, p.article_id AS article_id_1, q.article_id AS article_id_2, q.published_at AS detected_at, CASE p.article_id % 3 WHEN 0 THEN 'ru' WHEN 1 THEN 'kk' END AS lang_1, CASE q.article_id % 4 WHEN 0 THEN 'ru' WHEN 1 THEN 'en' END AS lang_2, x.sentiment AS sent_1, y.sentiment AS sent_2, abs(x.sentiment - y.sentiment) AS sentiment_delta FROM articles p JOIN articles q ON p.source_id = q.source_id AND q.article_id BETWEEN p.article_id + 1 AND p.article_id + 300 JOIN sources s ON p.source_id = s.source_id LEFT JOIN analysis x ON p.article_id = x.article_id LEFT JOIN analysis y ON q.article_id = y.article_id",
        "vectors": f"SELECT vec_id, label, {d.vector()} AS embedding FROM embeddings",
        "titles": f"SELECT doc_id, lang, source, text, {d.first_line('text')} AS title, CAST(doc_id * 7919 % 2592000 AS BIGINT) AS at_s, CAST(doc_id % 61 - 30 AS DOUBLE) / CAST(10 AS DOUBLE) AS sentiment FROM documents",
    }


def settle_ties(sql: str) -> str:
    """Add 1e-9 inside every round(x, n): sums that differ in their last bits, and ties, then round alike everywhere."""
    out, at = "", 0
    for m in re.finditer(r"\bround\(", sql):
        if m.start() < at:
            raise ValueError("round within round")
        depth, comma, k = 1, 0, m.end()
        while depth:
            c = sql[k]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                comma = k
            k += 1
        out += sql[at:comma] + " + 1e-9" + sql[comma:k]
        at = k
    return out + sql[at:]


def with_views(d: Dialect, body: str, sf_dir: str | None = None) -> str:
    """body with the views that it needs in front, in order; for Spark the tables are read from sf_dir."""
    every = {k: settle_ties(v) for k, v in views(d).items()}
    body = settle_ties(body)
    need: list[str] = []

    def add(text: str) -> None:
        for name, sql in every.items():
            if name not in need and re.search(rf"\b{name}\b", text):
                add(sql)
                if name not in need:
                    need.append(name)

    add(body)
    parts = [f"{n} AS ({every[n]})" for n in need]
    if sf_dir is not None:
        text = body + " ".join(every[n] for n in need)
        parts = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in TABLES if re.search(rf"\b{t}\b", text)] + parts
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def run_sql(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.sql(with_views(SPARK, body, sf_dir))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One domain view as a DataFrame."""
    return run_sql(spark, sf_dir, f"SELECT * FROM {name}")
