"""Posts, feeds and sitemaps landed from the tables, read through the data source, and taken apart by the parsers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import shared_dir
from ..sources import feeds, landed
from .engines import now, query

_POSTS = "SELECT source AS channel, source || '/' || doc_id AS external_id, 'https://t.me/' || source || '/' || doc_id AS url, md5(regexp_replace(text, '\\[([^\\]]+)\\]\\([^)]*\\)', '\\1', 'g')) AS body_md5, TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1 minute' AS published_at FROM documents WHERE length(trim(text)) > 0"


def _folder(df: DataFrame) -> str:
    return f"{shared_dir(df.sparkSession)}/lakepress/landed-{uuid.uuid4().hex}"


def _messages(docs: DataFrame) -> DataFrame:
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    return docs.select(F.col("source").alias("grp"), F.col("doc_id").cast("long").alias("n"), at.alias("at"), F.col("text").alias("body"))


def _posted(rows: DataFrame) -> DataFrame:
    none = rows.sparkSession.createDataFrame([], "channel string, last_id long")
    return feeds.channel_posts(landed.posts(rows), none).select("channel", "external_id", "url", F.md5("body").alias("body_md5"), "published_at")


@query("S07_posts_source", f"{_POSTS} AND doc_id > CASE WHEN source IN (SELECT source FROM documents WHERE doc_id < 20) THEN 100 ELSE -1 END")
def s07_source(v, t):
    """Posts beyond the last id known of their channel: whole files below it are not opened."""
    d = t("documents")
    folder = _folder(d)
    landed.land(_messages(d), folder)
    after = {r.source: 100 for r in d.where("doc_id < 20 AND source IS NOT NULL").select("source").distinct().collect()}  # at most twenty
    return _posted(landed.read(d.sparkSession, folder, after))


@query("S07_posts_stream", f"{_POSTS} AND doc_id > 0")
def s07_stream(v, t):
    """Posts (their ids begin at 1) that land in two portions, drained after each by a stream that starts anew where the last one stopped."""
    d = t("documents")
    spark, folder, out = d.sparkSession, _folder(d), _folder(d)
    half = d.agg(F.floor(F.max("doc_id") / 2)).first()[0] or 0
    for portion in (f"doc_id <= {half}", f"doc_id > {half}"):
        landed.land(_messages(d.where(portion)), folder)
        rows = landed.drain_to(landed.read_stream(spark, folder), out)
    return _posted(rows)


def _files(d: DataFrame, item, head: str, tail: str) -> DataFrame:
    """One file for fifty documents of a source: their items in order between head and tail."""
    x = d.where("source IS NOT NULL").select(F.col("source").alias("grp"), F.floor(F.col("doc_id") / 50).alias("n"), "doc_id", item.alias("x"))
    body = F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "x"))), lambda s: s["x"]), ""), F.lit(tail))
    return x.groupBy("grp", "n").agg(body.alias("body")).select("grp", "n", now().alias("at"), "body")


@query("S02_feeds_source", """SELECT 'https://' || source || '.example/' || doc_id AS external_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || ' & ' || doc_id END AS title, CASE WHEN doc_id % 2 = 0 THEN '' ELSE md5(text) || ' x' END AS body,
 CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-01-31 00:00:00' ELSE TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1 minute' END AS published_at FROM documents WHERE source IS NOT NULL AND doc_id % 6 <> 0""")
def s02_source(v, t):
    """Feeds of fifty entries a file; entries without title and body are left out, those without a date are of now."""
    d = t("documents")
    i = F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat("lang", F.lit(" &amp; "), i))
    body = F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat(F.lit("<![CDATA[<p>"), F.md5("text"), F.lit(" <b>x</b></p>]]>")))
    date = F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "EEE, d MMM yyyy HH:mm:ss Z"))
    item = F.concat(F.lit("<item><title>"), title, F.lit("</title><link>https://"), "source", F.lit(".example/"), i, F.lit("</link><description>"), body, F.lit("</description><pubDate>"), date, F.lit("</pubDate></item>"))
    folder = _folder(d)
    landed.land(_files(d, item, "<rss><channel>", "</channel></rss>"), folder)
    rows = feeds.rss(landed.read(d.sparkSession, folder), "body", now())
    return rows.select("external_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body"), "published_at")


@query("S06_sitemaps_source", "SELECT 'https://' || source || '.example/' || doc_id AS loc, CASE WHEN doc_id % 4 <> 0 THEN CAST(2020 + doc_id % 5 AS VARCHAR) || '-05-01' END AS lastmod FROM documents WHERE source IS NOT NULL AND (doc_id % 4 = 0 OR doc_id % 5 >= 2)")
def s06_source(v, t):
    """Sitemaps of fifty pages a file; pages last changed before 2022 are left out."""
    d = t("documents")
    mod = F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.concat(F.lit("<lastmod>"), (F.lit(2020) + F.col("doc_id") % 5).cast("string"), F.lit("-05-01</lastmod>")))
    item = F.concat(F.lit("<url><loc>https://"), "source", F.lit(".example/"), F.col("doc_id").cast("string"), F.lit("</loc>"), mod, F.lit("</url>"))
    folder = _folder(d)
    landed.land(_files(d, item, "<urlset>", "</urlset>"), folder)
    return feeds.sitemap(landed.read(d.sparkSession, folder), "body")


_FUEL = "SELECT n_regionkey, CASE WHEN n_nationkey % 6 = 5 THEN 'all' WHEN n_nationkey % 2 = 0 THEN chr(97 + CAST(n_nationkey % 19 AS INTEGER)) || 'x' ELSE chr(65 + CAST(n_nationkey % 19 AS INTEGER)) || 'X' END AS cc, n_name || ' ' || year AS grp, CASE WHEN year % 3 = 0 THEN '' ELSE 'in ' || year || ' ' || n_name END AS name, exports - 400 AS eur, imports - 400 AS tonne FROM trade JOIN nation ON n_name = country_code"


@query("S16_fuel_imports", f"""SELECT upper(cc) AS country_code, CAST(sum(eur) AS DOUBLE) AS total_eur, CAST(sum(tonne) AS DOUBLE) AS total_tonne, count(*) AS n, string_agg(CASE WHEN name = '' THEN grp ELSE name END, ',' ORDER BY eur DESC, grp) AS names,
 row_number() OVER (ORDER BY sum(eur) DESC, upper(cc)) AS world_rank FROM ({_FUEL}) x WHERE length(cc) = 2 AND (eur > 0 OR tonne > 0) GROUP BY 1""")
def s16(v, t):
    """One landed list of each region: bare for some, wrapped for the others."""
    x = v("trade").join(t("nation"), F.col("n_name") == F.col("country_code"))
    cc = F.when(F.col("n_nationkey") % 6 == 5, "all").when(F.col("n_nationkey") % 2 == 0, F.concat(F.chr(F.lit(97) + F.col("n_nationkey") % 19), F.lit("x"))).otherwise(F.concat(F.chr(F.lit(65) + F.col("n_nationkey") % 19), F.lit("X")))
    year = F.col("year").cast("string")
    name = F.when(F.col("year") % 3 == 0, "").otherwise(F.concat(F.lit("in "), year, F.lit(" "), "n_name"))
    row = F.struct(cc.alias("destination_iso2"), F.concat("n_name", F.lit(" "), year).alias("commodity_group"), name.alias("commodity_group_name"), (F.col("exports") - 400).alias("value_eur"), (F.col("imports") - 400).alias("value_tonne"))
    lists = x.groupBy("n_regionkey").agg(F.to_json(F.collect_list(row)).alias("j"))
    body = F.when(F.col("n_regionkey") % 2 == 0, F.col("j")).otherwise(F.concat(F.lit('{"data": '), "j", F.lit("}")))
    out = feeds.fuel_imports(lists.select(body.alias("body")), "body")
    return out.select("country_code", "total_eur", "total_tonne", F.size("commodities").cast("long").alias("n"), F.array_join("commodities.name", ",").alias("names"), F.col("world_rank").cast("long").alias("world_rank"))
