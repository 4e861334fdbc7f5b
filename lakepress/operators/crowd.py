"""Crowd temperature, audience pairs and splits, market pressure, brief inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import newest_like
from ..functions.similarity import class_pairs, expanded, trigram_classes, trigram_numbers
from .asof import asof_join
from .graph import materialize
from .interval import cells_within

#: Thresholds at which audience pairs are looked for, the highest first; of four places, as similarities are rounded.
AUDIENCE_STEPS = [0.999, 0.85, 0.6]
#: Articles, about, in the first portion of time that a post is compared with.
PORTION = 256
#: Posts, and articles, of a cell in which they are compared.
MEETING = 8192


def crowd_temperature(comments: DataFrame, media: DataFrame, as_of: Column, days: int = 999, tau_days: float = 7.0) -> DataFrame:
    """Per country over comments that are no bots: temperature, mode emotion, ratios, bot ratio, gap to the media."""
    rows = comments.where(F.col("published_at") > as_of - F.make_dt_interval(F.lit(days)))
    bots = rows.groupBy("country_code").agg(F.avg((F.col("bot_score") >= 0.5).cast("double")).alias("bot"))
    own = rows.where("bot_score < 0.5")
    w = F.exp(-(F.unix_micros(as_of) - F.unix_micros("published_at")) / 8.64e10 / tau_days)
    ratio = lambda s: F.avg((F.col("stance") == s).cast("double"))
    g = own.groupBy("country_code").agg((F.sum(F.col("sentiment") * w) / F.sum(w) * 20).alias("t"), ratio("pro").alias("pro"), ratio("anti").alias("anti"), F.count("*").alias("n"))
    mode = own.groupBy("country_code", "emotion").agg(F.count("*").alias("k"), F.max("published_at").alias("at"))
    mode = mode.withColumn("rn", F.row_number().over(Window.partitionBy("country_code").orderBy(F.desc("k"), F.desc("at"), "emotion"))).where("rn = 1").select("country_code", "emotion")
    latest = media.groupBy("country_code").agg(F.max_by("temperature", "day").alias("media"))
    out = g.join(bots, "country_code").join(mode, "country_code").join(latest, "country_code", "left")
    t = F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.col("t")))
    r = lambda c, n: F.round(c + 1e-9, n)
    return out.select("country_code", r(t, 2).alias("temperature"), "emotion", r(F.col("pro"), 2).alias("pro"), r(F.col("anti"), 2).alias("anti"), r(F.col("bot"), 2).alias("bot_ratio"), "n", r(F.col("media") - t, 2).alias("elite_gap"))


def audience_pairs(titles: DataFrame, above: float = 0.3, within_s: int = 172800, gap: float = 1.0, most: int = 200) -> DataFrame:
    """Pairs of one source in two languages with like titles, near in time, apart in sentiment; the `most` most alike.

    Titles are compared from a high threshold down: once `most` pairs lie over one, none under it can be among them.
    """
    near = (F.abs(F.col("a.at_s") - F.col("b.at_s")) < within_s) & (F.col("a.lang") != F.col("b.lang")) & (F.abs(F.col("a.sentiment") - F.col("b.sentiment")) >= gap)
    members, classes = trigram_classes(titles, "article_id", "title", ["source"], ["at_s", "lang", "sentiment"])
    members = materialize(members, "members")
    for step in [x for x in AUDIENCE_STEPS if x > above] + [above]:
        p = expanded(members, classes, materialize(class_pairs(classes, step), "class-pairs"), "article_id", near)
        top = p.withColumn("sim", F.round(F.col("sim") + 1e-9, 4)).orderBy(F.desc("sim"), "id_1", "id_2").limit(most)
        if step > above:
            top = materialize(top, "top")
            if top.where(F.col("sim") > step).count() == most:
                break
    return top.orderBy(F.desc("sim"), "id_1", "id_2")


def audience_split(pairs: DataFrame, as_of: Column, days: int = 30, most: int = 500) -> DataFrame:
    """Per source over its article pairs: means of its first two languages, and whether they differ.

    pairs: source_id, country_code, detected_at, lang_1, lang_2, sent_1, sent_2, sentiment_delta, article_id_1,
    article_id_2. The `most` pairs of the largest delta are looked at. A null language is ru on the first side, en on
    the second; a null sentiment is 0; means have 2 places; with one language the largest delta of a pair stands in.
    """
    recent = pairs.where(F.col("detected_at") > as_of - F.make_dt_interval(F.lit(days)))
    top = recent.orderBy(F.desc_nulls_first("sentiment_delta"), "article_id_1", "article_id_2").limit(most)
    side = lambda k, lang: F.struct(F.coalesce(f"lang_{k}", F.lit(lang)).alias("language"), F.coalesce(f"sent_{k}", F.lit(0.0)).alias("s"))
    said = top.select("source_id", F.explode(F.array(side(1, "ru"), side(2, "en"))).alias("x")).select("source_id", "x.*")
    means = said.groupBy("source_id", "language").agg(F.round(F.avg("s") + 1e-9, 2).alias("m"))
    langs = means.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("language", "m"))).alias("l"))
    g = top.groupBy("source_id").agg(F.max("country_code").alias("country_code"), F.count("*").alias("n_pairs"), F.max(F.coalesce("sentiment_delta", F.lit(0.0))).alias("widest")).join(langs, "source_id")
    a, b = F.get("l", F.lit(0)), F.get("l", F.lit(1))
    d = F.when(F.size("l") >= 2, F.abs(a["m"] - b["m"])).otherwise(F.col("widest"))
    return g.select("source_id", "country_code", "n_pairs", a["language"].alias("lang_1"), b["language"].alias("lang_2"), a["m"].alias("mean_1"), b["m"].alias("mean_2"), F.round(d + 1e-9, 2).alias("delta"), (d > 0.3).alias("significant"))


def _named(articles: DataFrame, channels: DataFrame) -> DataFrame:
    """(channel, article_id, at_s) of articles whose URL holds t.me/ and the channel: what follows each t.me/ is cut at all lengths and met by name."""
    after = F.transform(F.filter(F.sequence(F.lit(1), F.length("url")), lambda i: F.col("url").substr(i, F.lit(5)) == "t.me/"), lambda i: F.col("url").substr(i + 5, F.length("url")))
    starts = F.array_distinct(F.flatten(F.transform(after, lambda x: F.transform(F.sequence(F.lit(0), F.length(x)), lambda n: x.substr(F.lit(1), n)))))
    cut = articles.where(F.contains("url", F.lit("t.me/"))).select("article_id", "at_s", F.explode(starts).alias("channel"))
    return cut.join(channels.where("channel IS NOT NULL").select("channel").distinct(), "channel")


def link_posts(posts: DataFrame, articles: DataFrame, above: float = 0.3) -> DataFrame:
    """(post_id, article_id): for each channel post the newest article near in time with a like title or the channel's URL.

    posts: post_id, channel, text, at_s; articles: article_id, title, url, at_s. Near is two days before to one after;
    of articles of one time the smallest id; a post's first 100 characters stand for it. The newest URL of the channel
    is found by an as-of join. Titles are then compared from the newest back, in portions of the window that grow; a
    post leaves as soon as a portion has one, or lies before its URL's article. A portion is gone through in cells of posts
    and articles near each other, whose sets of trigrams meet by products of matrices; pairs are not made.
    """
    first, last = -172800, 86400
    p = posts.where("text IS NOT NULL AND text <> '' AND at_s IS NOT NULL").select("post_id", "channel", F.col("at_s").cast("long").alias("post_s"), trigram_numbers(F.substring("text", 1, 100)).alias("g"))
    p = p.withColumn("latest", F.col("post_s") + last)
    a = articles.where("at_s IS NOT NULL").select("article_id", F.col("at_s").cast("long").alias("at_s"), trigram_numbers(F.col("title")).alias("h"))
    urls = _named(articles, posts).select("channel", F.col("at_s").cast("long").alias("at_s"), (-F.col("article_id")).alias("i"))
    p = asof_join(p, urls, ["channel"], "latest", "at_s", ["i"], within=lambda t, at: at >= t - (last - first))
    p = materialize(p.select("post_id", "post_s", "g", F.when(F.col("i").isNotNull(), F.struct("at_s", "i")).alias("best")), "posts")
    found, kind = p.where("best IS NOT NULL").select("post_id", "best"), dict(p.dtypes)["post_id"]
    p = p.where("size(g) > 0")
    sizes = p.agg(F.min(F.size("g")).alias("lo"), F.max(F.size("g")).alias("hi")).first()  # sets too small or too large for all posts are like none
    a = materialize(a, "articles").where(F.size("h").between(max(1, above * (sizes.lo or 0) - 1e-6), (sizes.hi or 0) / above + 1e-6))
    span = a.agg(F.count("*").alias("n"), F.min("at_s").alias("lo"), F.max("at_s").alias("hi")).first()
    width = max(1, PORTION * (span.hi - span.lo + 1) // span.n) if span.n else last - first + 1
    right = a.select(F.lit(1).alias("k"), F.col("article_id").alias("id"), F.col("at_s").alias("t"), "h")
    top = last  # seconds after the post, the upper end of what is to be looked at
    while top >= first:
        low = max(first, top - width + 1)
        left = p.select(F.lit(1).alias("k"), "post_id", F.col("post_s").alias("s"), "g", F.coalesce("best.at_s", F.lit(-(1 << 63))).alias("at"), F.coalesce("best.i", F.lit(0)).alias("i"))
        like = cells_within(left, right, ["k"], "s", "t", -low, top, newest_like("post_id", above, low, top), f"post_id {kind}, at long, i long", MEETING)
        like = materialize(like.groupBy("post_id").agg(F.max(F.struct(F.col("at").alias("at_s"), "i")).alias("best")), "like")
        found = found.join(like, "post_id", "left_anti").union(like)
        p = p.join(like, "post_id", "left_anti").where(F.col("best").isNull() | (F.col("best.at_s") < F.col("post_s") + low))
        p = materialize(p, "posts")
        if p.isEmpty():
            break
        top, width = low - 1, width * 4
    return found.select("post_id", (-F.col("best.i")).alias("article_id"))


def market_pressure(usd_30: Column, index_30: Column) -> Column:
    return F.when(usd_30 > 2, 1).otherwise(0) + F.when(index_30 < -2, 1).otherwise(0)


def brief_inputs(movers: DataFrame, signals: DataFrame, headlines: DataFrame, samples: DataFrame, caps: tuple[int, int, int, int] = (12, 15, 15, 8)) -> DataFrame:
    """Sections (each: item, rank_key) cut to their caps; citations number headlines, then samples, in order."""
    parts = []
    for k, (name, df, cap) in enumerate(zip(("movers", "signals", "headlines", "samples"), (movers, signals, headlines, samples), caps, strict=True)):
        rn = F.row_number().over(Window.partitionBy(F.lit(k)).orderBy(F.desc("rank_key"), "item"))
        top = df.orderBy(F.desc("rank_key"), "item").limit(cap)
        parts.append(top.select(F.lit(k).alias("section"), F.lit(name).alias("name"), rn.alias("place"), "item"))
    out = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    cited = F.col("section") >= 2
    n = F.sum(cited.cast("int")).over(Window.partitionBy(F.lit(1)).orderBy("section", "place"))  # at most the caps' sum of rows
    return out.select("name", "place", "item", F.when(cited, n).alias("citation"))


def input_hash(df: DataFrame) -> DataFrame:
    """SHA-256 of the numbered inputs: a brief whose hash is stored already need not be made again."""
    lines = F.array_sort(F.collect_list(F.struct("name", "place", "item")))
    return df.agg(F.sha2(F.to_json(lines), 256).alias("source_hash"))
