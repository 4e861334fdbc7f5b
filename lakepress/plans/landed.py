"""Queries over text rules and landed files; the files' strings are put together from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import crowd
from ..sources import feeds, sinks
from .engines import _TRI, now, query

_DOC = "SELECT doc_id, source, doc_id % 7 AS k FROM documents"


def _docs(t):
    return t("documents").select("doc_id", "source", (F.col("doc_id") % 7).alias("k"))


def _case(*values: str):
    """One of the values by k: a function that gives the column, and SQL."""

    def column():
        col = F.lit(None).cast("string")
        for i, v in enumerate(values):
            col = F.when(F.col("k") % len(values) == i, F.lit(v)).otherwise(col)
        return col

    return column, f"CASE k % {len(values)} " + " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values)) + " END"


_KEYS, _ = _case("Визит Вэнса в Ереван!", "Trump и Biden о мире", "переговоры с Россией по газу - 2024", "a b из-за vance")
_KEYS_OUT = _case("визит вэнс ереван", "трамп байден мире", "переговоры россия газу 2024", "из-за вэнс")[1]


@query("T03_event_key", f"SELECT doc_id, {_KEYS_OUT} AS event_key FROM ({_DOC}) d")
def t03(v, t):
    return _docs(t).select("doc_id", text.normalize_event_key(_KEYS()).alias("event_key"))


@query("T07_citations", f"SELECT doc_id, CASE WHEN k IN (1, 2) THEN 'A [1] B [' || k || '] C' ELSE 'A [1] B C' END AS content, CASE WHEN k = 2 THEN '1,2' ELSE '1' END AS used FROM ({_DOC}) d")
def t07(v, t):
    content, valid = F.concat(F.lit("A [1] B ["), F.col("k").cast("string"), F.lit("] C")), F.array(F.lit(1), F.lit(2))
    return _docs(t).select("doc_id", text.apply_citations(content, valid).alias("content"), F.array_join(text.used_citations(content, valid).cast("array<string>"), ",").alias("used"))


_TOPICS, _ = _case("Energy, finance ,bad topic, culture-sport, security", "", "ENERGY,energy,Ukraine War", "none")


@query("T08_topics", f"SELECT doc_id, {_case('energy,finance,culture_sport', '', 'energy,ukraine_war', '')[1]} AS topics FROM ({_DOC}) d")
def t08(v, t):
    return _docs(t).select("doc_id", F.array_join(text.topics_of_list(_TOPICS()), ",").alias("topics"))


@query("T12_masked_key", "SELECT doc_id, substr(h, 1, 8) || '…' || right(h, 4) AS masked FROM (SELECT doc_id, sha256(CAST(doc_id AS VARCHAR)) AS h FROM documents) d")
def t12(v, t):
    return t("documents").select("doc_id", text.mask_key(F.sha2(F.col("doc_id").cast("string"), 256)).alias("masked"))


@query("T13_signed", "SELECT article_id, format('{:+.1f}', sentiment) AS s FROM star WHERE sentiment IS NOT NULL")
def t13(v, t):
    return v("star").where("sentiment IS NOT NULL").select("article_id", text.signed(F.col("sentiment")).alias("s"))


@query("F11_relevant", "SELECT article_id, regexp_matches(lower(concat_ws(' ', title, body)), 'russia|sco') AS relevant FROM notes")
def f11(v, t):
    return v("notes").select("article_id", text.relevant(F.col("title"), F.col("body")).alias("relevant"))


_TITLES, _ = _case("Error 404: page is gone", "  News of the   day: &#8217;all&eacute;&amp;lt; quiet ", "short", "Home | a site", "https://a.example/x/y/z", "A plain headline | РИА Новости")


@query("F12_garbage_title", f"SELECT doc_id, {_case('-', 'News of the day: ’allé&lt; quiet', '-', '-', '-', 'A plain headline')[1]} AS title FROM ({_DOC}) d")
def f12(v, t):
    return _docs(t).select("doc_id", F.coalesce(text.clean_title(_TITLES()), F.lit("-")).alias("title"))


_VALID, _ = _case("  Саммит в Казани ", "отношения", "кратко", "двусторонние отношения", "развитие торговли и связей")


@query("F14_valid_key", f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {_case('саммит в казани', '', '', '', 'развитие торговли и связей')[1]} END AS event_key FROM ({_DOC}) d")
def f14(v, t):
    return _docs(t).select("doc_id", text.valid_event_key(_VALID(), F.col("doc_id") % 3 != 0).alias("event_key"))


_AGENTS, _AGENTS_SQL = _case("Mozilla/5.0", "Googlebot/2.1", "curl/8.0", "python-requests/2", "Safari")


@query("F16_bots", f"SELECT doc_id, {_AGENTS_SQL} IN ('Googlebot/2.1', 'curl/8.0', 'python-requests/2') AS bot FROM ({_DOC}) d")
def f16(v, t):
    return _docs(t).select("doc_id", text.is_bot(_AGENTS()).alias("bot"))


@query("R04_first_objects", "SELECT event_id, event_type || '|' || user_id AS titles FROM events")
def r04(v, t):
    body = F.concat(F.lit('[{"title": "'), "event_type", F.lit('"}, {"title": "'), F.col("user_id").cast("string"), F.lit('", "n": 2}, {"title": "third"}]'))
    return t("events").select("event_id", F.array_join(text.first_fields(body, "title", 2), "|").alias("titles"))


@query("R06_match_confidence", "SELECT doc_id, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'license') THEN CAST(0.95 AS DOUBLE) WHEN contains(lower(text), 'the') THEN CAST(0.9 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS confidence FROM documents")
def r06(v, t):
    return t("documents").select("doc_id", text.match_confidence(F.col("text"), ["Idiot", "LICENSE"], ["the"]).alias("confidence"))


@query("R07_extract_json", "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN props END AS body FROM events")
def r07(v, t):
    said = F.concat(F.lit("Sure! ```json "), F.when(F.col("event_id") % 3 == 0, F.lit("{broken: ")).otherwise(F.lit("")), "props", F.lit(" ``` done"))
    return t("events").select("event_id", text.extract_json(said).alias("body"))


@query("R09_code_map", "SELECT n_name, CASE n_nationkey WHEN 2 THEN 'US' WHEN 20 THEN 'CA' WHEN 5 THEN 'XX' END AS iso2 FROM nation")
def r09(v, t):
    return t("nation").select("n_name", text.mapped(F.col("n_nationkey"), {"2": "US", "20": "CA", "5": "XX"}).alias("iso2"))


@query("A08_json_agg", "SELECT source_id, CAST(to_json(list({'article_id': article_id, 'action_level': action_level} ORDER BY article_id)) AS VARCHAR) AS articles FROM star GROUP BY 1")
def a08(v, t):
    rows = F.array_sort(F.collect_list(F.struct("article_id", "action_level")))
    return v("star").groupBy("source_id").agg(F.to_json(rows).alias("articles"))


_LISTS = "SELECT CASE WHEN s_suppkey % 11 = 0 THEN 'EU0' ELSE chr(CAST(65 + s_nationkey AS INTEGER)) || 'q' END AS country, s_suppkey, s_suppkey % 90 AS n, s_suppkey % 3 <> 0 AS sanctions FROM supplier"


@query("A23_sanction_lists", f"SELECT upper(country) AS cc, count(*) AS lists_count, CAST(sum(n) AS BIGINT) AS target_count, max('2024-01-' || lpad(CAST(1 + n % 28 AS VARCHAR), 2, '0')) AS last_change, string_agg('list-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') || '=' || n, ',' ORDER BY s_suppkey) AS programs FROM ({_LISTS}) l WHERE sanctions AND length(country) = 2 GROUP BY 1")
def a23(v, t):
    s = t("supplier")
    country = F.when(F.col("s_suppkey") % 11 == 0, "EU0").otherwise(F.concat(F.chr(F.col("s_nationkey") + 65), F.lit("q")))
    n, pad = F.col("s_suppkey") % 90, lambda c, k: F.lpad(c.cast("string"), k, "0")
    one = F.to_json(F.struct(F.concat(F.lit("list-"), pad(F.col("s_suppkey"), 9)).alias("name"), F.array(F.when(F.col("s_suppkey") % 3 != 0, "sanctions").otherwise("pep")).alias("collections"), F.struct(country.alias("country")).alias("publisher"), n.alias("target_count"), F.concat(F.lit("2024-01-"), pad(n % 28 + 1, 2), F.lit("T00:00:00")).alias("last_change")))
    out = feeds.sanction_lists(s.select(F.concat(F.lit("["), one, F.lit("]")).alias("body")), "body")
    return out.withColumn("programs", F.array_join(F.transform("programs", lambda p: F.concat_ws("=", p["name"], p["targets"])), ","))


@query("S09_timelines", "SELECT coalesce(a.day, b.day) AS day, coalesce(a.country_code, b.country_code) AS country_code, a.volume, round(a.volume / CAST(norm AS DOUBLE), 6) AS share, b.tone FROM (SELECT day, country_code, volume, sum(volume) OVER (PARTITION BY day) AS norm FROM gdelt WHERE volume % 4 <> 0) a FULL OUTER JOIN (SELECT day, country_code, tone FROM gdelt WHERE volume % 3 <> 0) b ON a.day = b.day AND a.country_code = b.country_code")
def s09(v, t):
    from pyspark.sql import Window

    volume = v("gdelt").where("volume % 4 <> 0").select("day", "country_code", "volume", F.sum("volume").over(Window.partitionBy("day")).alias("norm"))
    return feeds.timelines(volume, v("gdelt").where("volume % 3 <> 0").select("day", "country_code", "tone"))


@query("S10_samples", "SELECT g.day, g.country_code, CASE WHEN g.day = DATE '2024-01-30' THEN s.titles END AS titles FROM gdelt g LEFT JOIN (SELECT country_code, string_agg(CAST(article_id AS VARCHAR), ',' ORDER BY rn) AS titles FROM (SELECT country_code, article_id, row_number() OVER (PARTITION BY country_code ORDER BY published_at DESC, article_id) AS rn FROM star) x WHERE rn <= 12 GROUP BY 1) s USING (country_code)")
def s10(v, t):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("country_code").orderBy(F.desc("published_at"), "article_id"))
    samples = v("star").select("country_code", place.alias("place"), F.col("article_id").cast("string").alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("url", "domain", "language", "seendate")])
    out = feeds.day_samples(v("gdelt").select("day", "country_code"), samples, F.lit("2024-01-30").cast("date"))
    return out.select("day", "country_code", F.when(F.col("article_samples").isNotNull(), F.array_join(F.transform("article_samples", lambda s: s["title"]), ",")).alias("titles"))


@query("S11_rates", "SELECT currency, day, round(rate / 10, 4) AS rate FROM (SELECT currency, day, CAST(CAST(rate AS DECIMAL(18, 2)) AS DOUBLE) AS rate FROM fx) f WHERE currency NOT IN ('NATION_3', 'NATION_4')")
def s11(v, t):
    one = F.concat(F.lit('<Valute ID="x"><CharCode>'), "currency", F.lit("</CharCode><Nominal>10</Nominal><Value>"), F.replace(F.col("rate").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")), F.lit("</Value></Valute>"))
    files = v("fx").groupBy("day").agg(F.concat(F.lit('<ValCurs Date="x">'), F.array_join(F.collect_list(one), ""), F.lit("</ValCurs>")).alias("xml"))
    known = [f"NATION_{k}" for k in range(25) if k not in (3, 4)]
    return feeds.currency_rates(files, "xml", known, "day").withColumn("rate", F.round(F.col("rate") + 1e-9, 4))


@query("S14_sdmx", "SELECT country_code, year, 'export' AS flow, exports AS value_usd FROM trade WHERE exports > 0 UNION ALL SELECT country_code, year, 'import', imports FROM trade WHERE imports > 0")
def s14(v, t):
    obs = lambda c: F.array_join(F.collect_list(F.concat(F.lit('<Obs TIME_PERIOD="'), F.col("year").cast("string"), F.lit('" OBS_VALUE="'), F.col(c).cast("string"), F.lit('.5"/>'))), "")
    series = lambda i, c: F.concat(F.lit(f'<Series INDICATOR="{i}">'), obs(c), F.lit("</Series>"))
    x = v("trade").withColumn("exports", F.when(F.col("exports") > 0, F.col("exports")).otherwise(-1)).withColumn("imports", F.when(F.col("imports") > 0, F.col("imports")).otherwise(-1))
    files = x.groupBy("country_code").agg(F.concat(F.lit('<Data><DataSet><Group ID="g"/>'), series("XG_FOB_USD", "exports"), series("TMG_CIF_USD", "imports"), F.lit("</DataSet></Data>")).alias("xml"))
    return feeds.sdmx_trade(files, "xml", "country_code")


@query("S17_records", "SELECT p_partkey, p_size, p_brand FROM part")
def s17(v, t):
    files = t("part").groupBy(F.lit(1)).agg(F.collect_list(F.array(F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), "p_brand")).alias("data")).withColumn("columns", F.array(F.lit("SECID"), F.lit("SIZE"), F.lit("BRAND")))
    return feeds.column_records(files, "columns", "data", ["SECID", "SIZE", "BRAND"]).select(F.col("SECID").cast("long").alias("p_partkey"), F.col("SIZE").cast("int").alias("p_size"), F.col("BRAND").alias("p_brand"))


@query("S17_index_cards", "SELECT currency AS secid, last_ AS last, CASE WHEN first_ <> 0 THEN round((last_ - first_) / first_ * 100, 2) END AS change_pct, n AS points FROM (SELECT currency, arg_max(rate, day) AS last_, arg_min(rate, day) AS first_, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY day DESC) AS rn FROM fx) x WHERE rn <= 30 GROUP BY 1) g")
def s17b(v, t):
    out = feeds.index_cards(v("fx").select(F.col("currency").alias("secid"), "day", F.col("rate").alias("value")))
    return out.select("secid", "last", "change_pct", F.size("spark").cast("long").alias("points"))


@query("S07_channel_posts", "SELECT source AS channel, source || '/' || doc_id AS external_id, 'https://t.me/' || source || '/' || doc_id AS url FROM documents WHERE length(trim(text)) > 0 AND doc_id > CASE WHEN source IN (SELECT source FROM documents WHERE doc_id < 20) THEN 100 ELSE 0 END")
def s07(v, t):
    d = t("documents")
    last = d.where("doc_id < 20").select(F.col("source").alias("channel"), F.lit(100).alias("last_id")).distinct()
    posts = d.select(F.col("source").alias("channel"), F.col("doc_id").alias("post_id"), "text", now().alias("at"))
    return feeds.channel_posts(posts, last).select("channel", "external_id", "url")


@query("S22_span", "SELECT country_code, thread_key, least(first_seen, f2) AS first_seen, greatest(last_seen, l2) AS last_seen FROM (SELECT *, first_seen + INTERVAL '3 days' AS f2, last_seen + INTERVAL '3 days' AS l2 FROM threads) x")
def s22(v, t):
    old = v("threads").select("country_code", "thread_key", "first_seen", "last_seen")
    later = old.withColumn("first_seen", F.col("first_seen") + F.expr("INTERVAL 3 DAY")).withColumn("last_seen", F.col("last_seen") + F.expr("INTERVAL 3 DAY"))
    return sinks.upsert_span(old, later, ["country_code", "thread_key"], "first_seen", "last_seen")


@query("S29_sync", "SELECT n.n_name AS country_code, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN 'skip' WHEN s_suppkey % 4 = 1 THEN 'update' ELSE 'insert' END AS action FROM supplier JOIN nation n ON n_nationkey = s_nationkey WHERE n_regionkey < 4")
def s29(v, t):
    new = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("country_code"), F.col("s_name").alias("name"), F.concat(F.lit("http://"), "s_name").alias("url"), "s_suppkey")
    old = new.where("s_suppkey % 4 < 2").withColumn("url", F.when(F.col("s_suppkey") % 4 == 0, F.col("url")).otherwise(F.lit("http://old")))
    known = t("nation").where("n_regionkey < 4").select(F.col("n_name").alias("country_code"))
    return sinks.sync_catalog(old, new, known).drop("url")


_POSTS = f"SELECT doc_id AS id, source, at_s + 3600 AS at_s, {_TRI.format(x='substr(text, 1, 100)')} AS g FROM titles WHERE text <> ''"
_ARTS = f"SELECT doc_id AS id, CASE WHEN doc_id % 50 = 0 THEN 'http://t.me/' || source ELSE 'http://x' END AS url, at_s, {_TRI.format(x='title')} AS g FROM titles"
_DAYS = "b.at_s BETWEEN a.at_s - 172800 AND a.at_s + 86400"


@query("J15_post_links", f"SELECT post_id, arg_max(article_id, (at_s, -article_id)) AS article_id FROM (SELECT post_id, article_id, at_s FROM (SELECT a.id AS post_id, b.id AS article_id, b.at_s, a.n AS n1, b.n AS n2, count(*) AS k FROM (SELECT *, len(g) AS n, unnest(g) AS x FROM ({_POSTS}) p) a JOIN (SELECT *, len(g) AS n, unnest(g) AS x FROM ({_ARTS}) q) b ON a.x = b.x AND {_DAYS} GROUP BY 1, 2, 3, 4, 5) z WHERE k >= 0.3 * (n1 + n2 - k) UNION ALL SELECT a.id, b.id, b.at_s FROM ({_POSTS}) a JOIN ({_ARTS}) b ON {_DAYS} AND contains(b.url, 't.me/' || a.source)) y GROUP BY 1")
def j15(v, t):
    x = v("titles")
    posts = x.select(F.col("doc_id").alias("post_id"), F.col("source").alias("channel"), "text", (F.col("at_s") + 3600).alias("at_s"))
    articles = x.select(F.col("doc_id").alias("article_id"), "title", F.when(F.col("doc_id") % 50 == 0, F.concat(F.lit("http://t.me/"), "source")).otherwise("http://x").alias("url"), "at_s")
    return crowd.link_posts(posts, articles)
