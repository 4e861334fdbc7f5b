"""Parsers of landed feed files: a source's bytes arrive as a string column, rows leave as typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extract_title, squeeze, strip_links, unescape

RSS = "channel STRUCT<item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, content_encoded: STRING, content: STRING, summary: STRING, pubDate: STRING, updated: STRING, created: STRING>>>"
SITEMAP_INDEX = "sitemap ARRAY<STRUCT<loc: STRING, lastmod: STRING>>"
SITEMAP = "url ARRAY<STRUCT<loc: STRING, lastmod: STRING>>"
ATOM = "entry ARRAY<STRUCT<title: STRING, link: STRUCT<_href: STRING>, summary: STRING, content: STRING, published: STRING, updated: STRING>>"
SDMX = "DataSet STRUCT<Series: ARRAY<STRUCT<_INDICATOR: STRING, Obs: ARRAY<STRUCT<_TIME_PERIOD: STRING, _OBS_VALUE: STRING>>>>>"
DATASETS = "array<struct<name: string, title: string, collections: array<string>, publisher: struct<country: string>, target_count: long, last_change: string>>"
FUELS = "array<struct<destination_iso2: string, commodity_group: string, commodity_group_name: string, value_eur: string, value_tonne: string>>"
# Fixed values.
SKIP = r"(?i)/tag/|/tags/|/category/|/author/|/user/|/login|/register|/search|/about|/contact|/privacy|/terms|/feed|/rss|\.pdf$|\.jpg$|\.png$|\.gif$|\.mp4$|\.mp3$|#|javascript:|mailto:"
RATES = "_Date STRING, Valute ARRAY<STRUCT<CharCode: STRING, Nominal: STRING, Value: STRING>>"


def strip_tags(c: Column) -> Column:
    return squeeze(unescape(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>", " ")))


def rss(df: DataFrame, xml: str, now: Column, most: int = 10000) -> DataFrame:
    """Items: external_id (link or the title's front), title, body without tags, published_at with its fall-backs.

    The body is the content if there is one, else the summary, else the description. Items with neither title nor body
    are left out.
    """
    plain = F.replace(F.replace(F.col(xml), F.lit("<content:encoded"), F.lit("<content_encoded")), F.lit("</content:encoded"), F.lit("</content_encoded"))
    items = df.select(F.explode(F.from_xml(plain, RSS)["channel"]["item"]).alias("i"))
    when = lambda c: F.try_to_timestamp(F.regexp_replace(F.col(c), r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    at = F.coalesce(when("i.pubDate"), when("i.updated"), when("i.created"), now)
    full = F.coalesce(*[F.nullif(F.trim(f"i.{c}"), F.lit("")) for c in ("content_encoded", "content", "summary", "description")])
    link = F.nullif(F.trim("i.link"), F.lit(""))
    rows = items.select(F.coalesce(link, F.substring("i.title", 1, 200)).alias("external_id"), squeeze(F.col("i.title")).alias("title"), F.substring(strip_tags(full), 1, most).alias("body"), at.alias("published_at"))
    return rows.where((F.length("title") > 0) | (F.length("body") > 0))


def atom(df: DataFrame, xml: str, now: Column, most: int = 10000) -> DataFrame:
    """Entries of an Atom feed, in rss's columns."""
    e = df.select(F.explode(F.from_xml(F.col(xml), ATOM)["entry"]).alias("e"))
    at = F.coalesce(F.try_to_timestamp("e.published"), F.try_to_timestamp("e.updated"), now)
    return e.select(F.coalesce("e.link._href", F.substring("e.title", 1, 200)).alias("external_id"), squeeze(F.col("e.title")).alias("title"), F.substring(strip_tags(F.coalesce("e.summary", "e.content")), 1, most).alias("body"), at.alias("published_at"))


def sdmx_trade(df: DataFrame, xml: str, country: str) -> DataFrame:
    """(country, year, flow, value_usd) of SDMX series: exports by their indicator, all others imports; years and values over 0."""
    s = df.select(country, F.explode(F.from_xml(F.col(xml), SDMX)["DataSet"]["Series"]).alias("s")).where("s._INDICATOR IS NOT NULL AND s._INDICATOR <> ''")
    o = s.select(country, F.when(F.col("s._INDICATOR") == "XG_FOB_USD", "export").otherwise("import").alias("flow"), F.explode("s.Obs").alias("o"))
    x = o.select(country, F.col("o._TIME_PERIOD").try_cast("int").alias("year"), "flow", F.col("o._OBS_VALUE").try_cast("double").alias("v"))
    return x.where("year > 0 AND v > 0").select(country, "year", "flow", F.floor("v").cast("long").alias("value_usd"))


def sanction_lists(df: DataFrame, body: str) -> DataFrame:
    """Per jurisdiction of two letters (cc): lists_count, target_count, last_change and its programs, by name."""
    d = df.select(F.explode(F.from_json(F.col(body), DATASETS)).alias("d")).select("d.*").where(F.array_contains("collections", "sanctions"))
    d = d.select(F.upper("publisher.country").alias("cc"), "name", "title", F.coalesce("target_count", F.lit(0)).alias("targets"), F.nullif(F.substring("last_change", 1, 10), F.lit("")).alias("last_change")).where("length(cc) = 2")
    return d.groupBy("cc").agg(F.count("*").alias("lists_count"), F.sum("targets").alias("target_count"), F.max("last_change").alias("last_change"), F.array_sort(F.collect_list(F.struct("name", "title", "targets", "last_change"))).alias("programs"))


def fuel_imports(df: DataFrame, body: str) -> DataFrame:
    """Per importer of two letters (country_code): total_eur, total_tonne, its commodities from the largest on, and world_rank.

    A landed body is a list of rows, or an object that holds it as `data`; others give no rows. Rows without a value over
    0 are left out, values that are no numbers count as 0, a commodity without a name has its group's. Importers of
    equal totals rank by their letters; there are at most 676, so the ranking is one small task.
    """
    bare = F.ltrim(body).startswith("[")
    listed = F.when(bare, F.from_json(F.col(body), FUELS)).otherwise(F.from_json(F.col(body), f"struct<data: {FUELS}>")["data"])
    r = df.select(F.explode(listed).alias("r")).select("r.*")
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    name = F.coalesce(F.nullif(F.col("commodity_group_name"), F.lit("")), F.col("commodity_group"))
    r = r.select(F.upper("destination_iso2").alias("country_code"), F.col("commodity_group").alias("grp"), name.alias("name"), number("value_eur").alias("eur"), number("value_tonne").alias("tonne"))
    r = r.where(F.col("country_code").rlike(r"^\p{L}{2}$") & ((F.col("eur") > 0) | (F.col("tonne") > 0)))
    item = F.struct((-F.round("eur", 2)).alias("order"), F.col("grp").alias("group"), "name", F.round("eur", 2).alias("value_eur"), F.round("tonne", 2).alias("value_tonne"))
    g = r.groupBy("country_code").agg(F.sum("eur").alias("total_eur"), F.sum("tonne").alias("total_tonne"), F.array_sort(F.collect_list(item)).alias("c"))
    rank = F.row_number().over(Window.orderBy(F.desc("total_eur"), "country_code"))
    return g.select("country_code", "total_eur", "total_tonne", F.transform("c", lambda x: x.dropFields("order")).alias("commodities"), rank.alias("world_rank"))


def channel_posts(posts: DataFrame, last: DataFrame) -> DataFrame:
    """New posts of channels: those beyond the last external id that is known, with a title from their text.

    posts: channel, post_id, text, at; last: channel, last_id. Posts without text are left out.
    """
    new = posts.join(last, "channel", "left").where((F.col("post_id") > F.coalesce("last_id", F.lit(0))) & (F.length(F.trim(F.coalesce("text", F.lit("")))) > 0))
    body = strip_links(F.col("text"))
    return new.select("channel", F.concat_ws("/", "channel", F.col("post_id").cast("string")).alias("external_id"), extract_title(body).alias("title"), body.alias("body"), F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), F.col("post_id").cast("string")).alias("url"), F.col("at").alias("published_at"))


def day_samples(days: DataFrame, samples: DataFrame, today: Column, most: int = 12) -> DataFrame:
    """days (day, country_code, ...) with the first samples (country_code, place, title, url, domain, language, seendate) on today's row."""
    top = samples.where(F.col("place") <= most)
    item = F.struct("place", F.substring(F.coalesce("title", F.lit("")), 1, 300).alias("title"), *[F.coalesce(c, F.lit("")).alias(c) for c in ("url", "domain", "language", "seendate")])
    lists = top.groupBy("country_code").agg(F.array_sort(F.collect_list(item)).alias("article_samples")).withColumn("day", today)
    return days.join(lists, ["day", "country_code"], "left")


def fetch_outcome(status: Column, error: Column, entries: Column, malformed: Column) -> Column:
    return (
        F.when(error == "timeout", "timeout").when(error.isNotNull(), "conn_error").when(status.isin(403, 451), "geoblock")
        .when(status >= 500, "http_5xx").when(status >= 400, "http_4xx").when(malformed & (entries == 0), "malformed").when(entries == 0, "empty_feed").otherwise("ok")
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in either quotes or none; null if it is absent or empty."""
    found = [F.nullif(F.regexp_extract(tag, rf"(?is)^<\w+\s(?:[^>]*?\s)?{name}\s*=\s*{form}", 1), F.lit("")) for form in (r'"([^"]*)"', r"'([^']*)'", r"""([^\s>"']+)""")]
    return F.trim(unescape(F.coalesce(*found)))


def _host(url: Column) -> Column:
    return F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def _absolute(href: Column, base: Column) -> Column:
    """href seen from a page's address, if it begins with a slash; other forms stay."""
    scheme = F.regexp_extract(base, r"(?i)^([a-z][a-z0-9+.-]*):", 1)
    return F.when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).when(href.startswith("/"), F.concat(scheme, F.lit("://"), _host(base), href)).otherwise(href)


def feed_links(pages: DataFrame) -> DataFrame:
    """(page_id, place, url): RSS and Atom feeds that a page's link tags name, in order."""
    tags = F.filter(F.regexp_extract_all("html", F.lit(r"(?is)<link\s[^>]*>"), F.lit(0)), lambda t: _attribute(t, "type").rlike(r"application/(rss|atom)\+xml"))
    x = pages.select("page_id", "url", F.posexplode(F.filter(F.transform(tags, lambda t: _attribute(t, "href")), lambda h: h.isNotNull())).alias("place", "href"))
    return x.select("page_id", "place", _absolute(F.col("href"), F.col("url")).alias("url"))


def page_links(pages: DataFrame, most: int = 20, least: int = 15) -> DataFrame:
    """(page_id, place, url, anchor): links of a page to its own site with enough text, the first ones, each once.

    pages: page_id, url, html. Links to pages of lists, accounts, notices, files and marks are left out.
    """
    tag = r"(?is)^<a\s[^>]*>"
    seen = lambda t: F.trim(unescape(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, tag, ""), r"\s*<[^>]*>\s*", ""), r"^\s+|\s+$", "")))
    links = F.transform(F.regexp_extract_all("html", F.lit(r"(?is)<a\s[^>]*>.*?</a>"), F.lit(0)), lambda t: F.struct(_attribute(t, "href").alias("href"), seen(t).alias("anchor")))
    x = pages.select("page_id", _host(F.col("url")).alias("host"), F.col("url").alias("base"), F.posexplode(links).alias("place", "a"))
    x = x.where((F.length("a.anchor") >= least) & (F.col("a.href").startswith("/") | F.col("a.href").startswith("http")))
    x = x.select("page_id", "host", "place", _absolute(F.col("a.href"), F.col("base")).alias("url"), F.col("a.anchor").alias("anchor"))
    x = x.where(F.contains(_host(F.col("url")), F.col("host")) & ~F.col("url").rlike(SKIP))
    first = x.groupBy("page_id", "url").agg(F.min(F.struct("place", "anchor")).alias("f")).select("page_id", "f.place", "url", "f.anchor")
    return first.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy("place"))).where(F.col("rn") <= most).drop("rn")


def discover(pages: DataFrame, items: DataFrame, most: int = 20, feeds: int = 2) -> DataFrame:
    """(page_id, url): articles of a page's first feeds; only where these give none, its links.

    items: feed_url, place, link of the feeds that have been read.
    """
    named = feed_links(pages).where(F.col("place") < feeds).select("page_id", F.col("place").alias("feed"), F.col("url").alias("feed_url"))
    read = named.join(items.where(F.length("link") > 0), "feed_url").groupBy("page_id", F.col("link").alias("url")).agg(F.min(F.struct("feed", "place")).alias("o"))
    read = read.withColumn("rn", F.row_number().over(Window.partitionBy("page_id").orderBy("o", "url"))).where(F.col("rn") <= most).select("page_id", "url")
    return read.unionByName(page_links(pages.join(read.select("page_id").distinct(), "page_id", "left_anti"), most).select("page_id", "url"))


def article(pages: DataFrame, now: Column) -> DataFrame:
    """(page_id, title, body): title up to 500 characters, body up to 10000."""
    title = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    return pages.select("page_id", F.substring(strip_tags(title), 1, 500).alias("title"), F.substring(strip_tags(F.regexp_replace("html", r"(?is)<head\b.*?</head>", " ")), 1, 10000).alias("body"), now.alias("published_at"))


def sitemap(df: DataFrame, xml: str, since: str = "2022") -> DataFrame:
    u = df.select(F.explode(F.from_xml(F.col(xml), SITEMAP)["url"]).alias("u")).select("u.loc", "u.lastmod")
    return u.where(F.col("lastmod").isNull() | (F.substring("lastmod", 1, 4) >= since))


def sitemap_children(df: DataFrame, xml: str, since: str = "2022") -> DataFrame:
    """(loc) of the sitemaps that an index names, but those last changed before `since`; each is then read as a sitemap."""
    c = df.select(F.explode(F.from_xml(F.col(xml), SITEMAP_INDEX)["sitemap"]).alias("c")).select("c.loc", "c.lastmod")
    return c.where(F.col("lastmod").isNull() | (F.substring("lastmod", 1, 4) >= since)).select("loc")


def to_fetch_again(attempts: DataFrame, most: int = 2) -> DataFrame:
    """Sources whose last attempt failed in a way that may pass, and that have not been tried `most` times since the last ok.

    A source that timed out is not tried again: the wait would hold up all others.
    attempts: source_id, at, outcome (see fetch_outcome).
    """
    w = Window.partitionBy("source_id").orderBy(F.desc("at"))
    runs = attempts.withColumn("rn", F.row_number().over(w)).withColumn("oks", F.count(F.when(F.col("outcome") == "ok", 1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.where("oks = 0").groupBy("source_id").agg(F.count("*").alias("tries"), F.min_by("outcome", "rn").alias("last"))
    return g.where((F.col("tries") < most) & F.col("last").isin("conn_error", "http_5xx")).select("source_id", "tries")


def index_cards(records: DataFrame, points: int = 30) -> DataFrame:
    """(secid, last, change_pct, spark): per index its newest value, its change over the last `points` values and these, oldest first.

    records: secid, day, value; values that are null are left out.
    """
    rn = F.row_number().over(Window.partitionBy("secid").orderBy(F.desc("day")))
    top = records.where("value IS NOT NULL").withColumn("rn", rn).where(F.col("rn") <= points)
    g = top.groupBy("secid").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "value"))), lambda x: x["value"]).alias("spark"))
    first, last = F.get("spark", F.lit(0)), F.element_at("spark", -1)
    return g.select("secid", last.alias("last"), F.when(first != 0, F.round((last - first) / first * 100 + 1e-9, 2)).alias("change_pct"), "spark")


def currency_rates(df: DataFrame, xml: str, known: list[str], *keep: str) -> DataFrame:
    """(keep, currency, rate) of the known currencies; values have a decimal comma and stand for `Nominal` units."""
    v = df.select(*keep, F.explode(F.from_xml(F.col(xml), RATES)["Valute"]).alias("v")).select(*keep, F.col("v.CharCode").alias("currency"), (F.replace(F.col("v.Value"), F.lit(","), F.lit(".")).cast("double") / F.col("v.Nominal").cast("double")).alias("rate"))
    return v.where(F.col("currency").isin(known) & (F.col("rate") > 0))


def timelines(volume: DataFrame, tone: DataFrame) -> DataFrame:
    """volume (day, country_code, volume, norm) and tone (day, country_code, tone) by day; share of all, 6 places."""
    return volume.join(tone, ["day", "country_code"], "full").select("day", "country_code", "volume", F.when(F.col("norm") > 0, F.round(F.col("volume") / F.col("norm"), 6)).alias("share"), "tone")


def first_by_priority(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources in order; a country that an earlier source covers is not taken from a later one."""
    all_ = None
    for k, p in enumerate(parts):
        q = p.withColumn("_p", F.lit(k))
        all_ = q if all_ is None else all_.unionByName(q)
    best = F.min("_p").over(Window.partitionBy("country_code"))
    x = all_.withColumn("_b", best).where("_p = _b").drop("_b")
    return x.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_p"))).where("_k = 1").drop("_p", "_k")


def first_row_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_k = 1").drop("_k")


def column_records(df: DataFrame, columns: str, data: str, names: list[str]) -> DataFrame:
    """JSON of column names and rows of values to one row for each record."""
    rows = df.select(F.col(columns).alias("c"), F.explode(data).alias("r"))
    return rows.select(*[F.element_at(F.map_from_arrays("c", "r"), n).alias(n) for n in names])


def pageview(hits: DataFrame, salt: str) -> DataFrame:
    """hits (event_id, ts, path, ip, agent, referrer): without bots, with a visitor hash of the day and the referrer's host."""
    from ..functions.text import is_bot

    day = F.to_date("ts")
    hashed = F.substring(F.sha2(F.concat_ws("|", F.lit(salt), day.cast("string"), "ip", "agent"), 256), 1, 16)
    return hits.where(~F.coalesce(is_bot(F.col("agent")), F.lit(False))).select("event_id", "ts", day.alias("day"), "path", hashed.alias("visitor_hash"), F.parse_url("referrer", F.lit("HOST")).alias("referrer_host"))
