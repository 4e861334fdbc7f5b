"""Narrative threads: clustering, scores, phases, relations, merging and life cycle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import cosine_between, cosine_join, cosine_links, trigram_classes, trigram_join, trigram_links
from ..functions.text import blacklisted, normalize_event_key
from .graph import connected_components, materialize

# Fixed values.
RESONANCE_LEVELS = {1: 0.5, 2: 0.8, 3: 1.2, 4: 1.8, 5: 2.5, 6: 3.0}
RESONANCE_BLACKLIST = ["прогноз погоды", "архив сайта", "поиск на сайте", "курс валют", "новости дня", "лента новостей", "главные новости"]


def resonance(star: DataFrame, as_of: Column, days: int = 14, least: int = 3, most: int = 10) -> DataFrame:
    """The `most` events of each country with most articles (at least three), with their resonance; without service pages."""
    rows = star.where(F.col("is_relevant") & F.col("sentiment").isNotNull() & (F.col("published_at") > as_of - F.make_dt_interval(F.lit(days))) & (F.length("event_key") > 3))
    span = (F.unix_micros(F.max("published_at")) - F.unix_micros(F.min("published_at"))) / 3.6e9
    g = rows.groupBy("country_code", "event_key").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("s"), F.countDistinct("tier").alias("t"), F.max("action_level").alias("al"), F.avg("sentiment").alias("mean"), span.alias("h")).where(F.col("n") >= least)
    place = F.row_number().over(Window.partitionBy("country_code").orderBy(F.desc("n"), "event_key"))
    g = g.withColumn("place", place).where(F.col("place") <= most)
    for word in RESONANCE_BLACKLIST:
        g = g.where(~F.contains("event_key", F.lit(word)))
    speed = F.when(F.col("h") < 6, 1.5).when(F.col("h") < 24, 1.2).otherwise(1.0)
    level = F.coalesce(F.nullif("al", F.lit(0)), F.lit(1))
    by_level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in RESONANCE_LEVELS.items() for x in (k, v)]), level.cast("int")), F.lit(1.0))
    score = 2 * F.log(F.col("n") + 1) * (F.col("s") / F.col("n") + 0.5) * (0.8 * F.col("t")) * speed * by_level
    return g.select("country_code", "event_key", "n", F.round(F.col("mean") + 1e-9, 2).alias("mean"), F.round(score + 1e-9, 1).alias("resonance"))


def importance(articles: DataFrame, as_of: Column, keys: tuple[str, ...] = ("country_code", "event_key")) -> DataFrame:
    """One row per thread: counts, shift of sentiment, velocity, escalation, importance, phase and status.

    A null action level counts as 1; the shift is over articles with a sentiment, of which there must be four.
    """
    order = Window.partitionBy(*keys).orderBy("published_at", "article_id")
    whole = Window.partitionBy(*keys)
    us = F.unix_micros("published_at").cast("double")
    x = articles.withColumn("al", F.coalesce(F.nullif("action_level", F.lit(0)), F.lit(1))).withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    x = x.withColumn("sn", F.count("sentiment").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("sents", F.count("sentiment").over(whole))
    x = x.withColumn("mid", (F.min(us).over(whole) + F.max(us).over(whole)) / 2).withColumn("us", us)
    x = x.withColumn("q", F.floor(F.col("sents") / 4)).withColumn("half", F.floor(F.col("n") / 2))
    mean = lambda cond, c: F.avg(F.when(cond, F.col(c)))
    g = x.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.max("al").alias("al"),
        F.countDistinct("source_id").alias("sources"),
        F.countDistinct("tier").alias("tiers"),
        F.min("published_at").alias("first_seen"),
        F.max("published_at").alias("last_seen"),
        F.countDistinct(F.to_date("published_at")).alias("dates"),
        F.when(F.max("sents") >= 4, mean(F.col("sentiment").isNotNull() & (F.col("sn") > F.col("sents") - F.col("q")), "sentiment") - mean(F.col("sentiment").isNotNull() & (F.col("sn") <= F.col("q")), "sentiment")).otherwise(0.0).alias("shift"),
        mean(F.col("rn") > F.col("half"), "al").alias("second"),
        mean(F.col("rn") <= F.col("half"), "al").alias("first"),
        F.count(F.when(F.col("us") <= F.col("mid"), 1)).alias("early"),
        F.count(F.when(F.col("us") > F.col("mid"), 1)).alias("late"),
    )
    silence = (F.unix_micros(as_of) - F.unix_micros("last_seen")) / 3.6e9
    age = (F.unix_micros(as_of) - F.unix_micros("first_seen")) / 3.6e9
    span = (F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 3.6e9
    g = g.withColumn("silence", silence).withColumn("age", age).withColumn("span", span)
    fresh = F.greatest(F.lit(0.1), 1 - F.col("silence") / 168)
    escalation = F.when(F.col("n") >= 2, F.greatest(F.lit(1.0), F.col("second") / F.greatest(F.col("first"), F.lit(0.5)))).otherwise(1.0)
    score = 3 * F.log(F.col("n") + 1) * F.col("al") * (F.log(F.col("sources") + 1) / math.log(10)) * (1 + 0.5 * F.col("tiers")) * fresh * escalation
    velocity = F.when(F.col("n") < 2, 0.0).otherwise(F.col("n") / (F.greatest(F.col("span"), F.lit(1.0)) / 24))
    phase = (
        F.when(F.col("silence") > 48, "resolved").when(F.col("silence") > 24, "cooling").when(F.col("age") < 12, "emerging")
        .when(F.col("late") > 1.3 * F.col("early"), "escalating").when(F.col("late") < 0.5 * F.col("early"), "cooling").otherwise("peak")
    )
    status = F.when(F.col("silence") > 72, "resolved").when(F.col("silence") > 48, "dormant").otherwise("developing")
    r = lambda c, n: F.round(c + 1e-9, n)
    return g.select(*keys, "n", "al", "sources", "tiers", r(F.col("shift"), 3).alias("sentiment_shift"), r(velocity, 2).alias("velocity"), r(score, 2).alias("importance"), phase.alias("arc_phase"), status.alias("status"))


def gate(threads: DataFrame, least_articles: int = 2, least_importance: float = 3.0) -> DataFrame:
    return threads.where((F.col("n") >= least_articles) & (F.col("importance") >= least_importance))


def cluster(articles: DataFrame, auto: float = 0.82, judge=None, maybe: float = 0.72, text_above: float = 0.25, embedded_share: float = 0.3) -> DataFrame:
    """(article_id, cluster): clusters of similar articles of a country; a cluster's id is the smallest article in it.

    articles: article_id, country_code, event_key, embedding. With more than `embedded_share` embedded, those are
    clustered by cosine: pairs from `auto` up, those from `maybe` up if judge (a function of the pair table) keeps them.
    The others, or else all, are clustered by their key: equal ones, those of one normal form, and those with trigrams
    alike. A cluster of keys that a cosine cluster of the country holds too joins it (the one of the smallest id).
    Articles without a vector are left out if their key has five characters or less or is of a service page; by keys,
    those without a key.
    """
    x = articles.select("article_id", "country_code", F.nullif(F.lower(F.trim("event_key")), F.lit("")).alias("key"), "embedding")
    x = x.where(F.col("embedding").isNotNull() | ((F.length("key") > 5) & ~blacklisted(F.col("key"))))
    n = x.agg(F.count("embedding").alias("e"), F.count("*").alias("n")).first()
    if n.e <= embedded_share * n.n:
        return _by_key(x.where("key IS NOT NULL"), text_above).select("article_id", "cluster")
    near = x.where("embedding IS NOT NULL")
    sure = materialize(cosine_links(near, "article_id", "embedding", auto, ["country_code"]), "sure")
    if judge:  # pairs in doubt matter between parts alone
        parts = _united(near.select("article_id"), sure, "article_id").select("article_id", F.col("cluster").alias("_part"))
        doubt = cosine_between(near.join(parts, "article_id"), "article_id", "embedding", maybe, ["country_code"])
        sure = sure.unionByName(judge(doubt.where(F.col("cos") < auto)).select("id_1", "id_2"))
    near = materialize(_united(near.drop("embedding"), sure, "article_id"), "near")
    if n.e == n.n:
        return near.select("article_id", "cluster")
    keyed = materialize(_by_key(x.where("embedding IS NULL"), text_above), "keyed")
    held = near.where("key IS NOT NULL").groupBy("country_code", "key").agg(F.min("cluster").alias("into"))
    met = keyed.select("country_code", "key", "cluster").distinct().join(held, ["country_code", "key"])
    met = materialize(met.groupBy("cluster").agg(F.min("into").alias("into")), "met")
    low = met.groupBy("into").agg(F.min("cluster").alias("low"))
    new = met.join(low, "into").select("cluster", F.least("into", "low").alias("new")).union(low.select("into", F.least("into", "low")))
    both = near.select("article_id", "cluster").union(keyed.select("article_id", "cluster"))
    return both.join(new, "cluster", "left").select("article_id", F.coalesce("new", "cluster").alias("cluster"))


def _united(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """rows with `cluster`: the smallest key that pairs (id_1, id_2) lead to, else their own."""
    parts = connected_components(pairs.select(F.col("id_1").alias("u"), F.col("id_2").alias("v")))
    return rows.join(parts, rows[key] == parts.node, "left").withColumn("cluster", F.coalesce("component", key)).drop("node", "component")


def _by_key(rows: DataFrame, above: float) -> DataFrame:
    """rows (article_id, country_code, key, cluster): a key is a node with the smallest article that has it, so frequent keys make no pairs."""
    keys = rows.groupBy("country_code", "key").agg(F.min("article_id").alias("first"))
    keys = materialize(keys.withColumn("form", normalize_event_key(F.col("key"))), "keys")
    heads = keys.groupBy("country_code", "form").agg(F.min("first").alias("head"))
    same = keys.join(heads, ["country_code", "form"]).where("first <> head").select(F.col("head").alias("id_1"), F.col("first").alias("id_2"))
    members, classes = trigram_classes(keys, "first", "key", ["country_code"])
    members = members.where("first <> rep").select(F.col("rep").alias("id_1"), F.col("first").alias("id_2"))
    alike = trigram_links(classes, above).union(members)
    return rows.select("article_id", "country_code", "key").join(_united(keys, same.union(alike), "first").select("country_code", "key", "cluster"), ["country_code", "key"])


def mean_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): element-wise means."""
    flat = rows.select(key, F.posexplode(vector).alias("i", "x")).groupBy(key, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return flat.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def related(threads: DataFrame, vectors: DataFrame | None, cos_above: float = 0.75, key_above: float = 0.3, strong: float = 5.0, other: float = 3.0) -> DataFrame:
    """(thread_id, related_id) between countries, by mean vectors or by keys; each pair once for each strong side.

    threads: thread_id, country_code, thread_key, importance; vectors: thread_id, embedding, or null.
    """
    near = trigram_join(threads, "thread_id", "thread_key", key_above).select("id_1", "id_2")
    if vectors is not None:
        near = near.union(cosine_join(vectors, "thread_id", "embedding", cos_above).select("id_1", "id_2"))
    both = near.union(near.select("id_2", "id_1")).distinct()
    a = threads.select(F.col("thread_id").alias("id_1"), F.col("country_code").alias("c1"), F.col("importance").alias("i1"))
    b = threads.select(F.col("thread_id").alias("id_2"), F.col("country_code").alias("c2"), F.col("importance").alias("i2"))
    out = both.join(a, "id_1").join(b, "id_2").where((F.col("c1") != F.col("c2")) & (F.col("i1") >= strong) & (F.col("i2") >= other))
    return out.select(F.col("id_1").alias("thread_id"), F.col("id_2").alias("related_id"))


def shared_articles(links: DataFrame) -> DataFrame:
    """(id_1, id_2, both): how many articles two threads share."""
    links = links.select("thread_id", "article_id").distinct()
    a, b = links.alias("a"), links.alias("b")
    on = (F.col("a.article_id") == F.col("b.article_id")) & (F.col("a.thread_id") < F.col("b.thread_id"))
    return a.join(b, on).groupBy(F.col("a.thread_id").alias("id_1"), F.col("b.thread_id").alias("id_2")).agg(F.count("*").alias("both"))


def overlap_pairs(links: DataFrame, least: int = 3, share: float = 0.7) -> DataFrame:
    """(id_1, id_2, share) of threads that share articles: at least three, and `share` of the smaller one."""
    size = links.select("thread_id", "article_id").distinct().groupBy("thread_id").agg(F.count("*").alias("size"))
    both = shared_articles(links).where(F.col("both") >= least)
    s1, s2 = size.select(F.col("thread_id").alias("id_1"), F.col("size").alias("n1")), size.select(F.col("thread_id").alias("id_2"), F.col("size").alias("n2"))
    out = both.join(s1, "id_1").join(s2, "id_2").withColumn("share", F.col("both") / F.least("n1", "n2"))
    return out.where(F.col("share") >= share).select("id_1", "id_2", "share")


def merge_in_order(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(gone, kept) after merging pairs (id_1, id_2, method, sim) one by one in order of method, -sim, ids.

    A pair with a thread that is gone is skipped; the larger thread is kept, of equal ones the smaller id. Each
    round takes every pair that is first in order among all live pairs of both its threads: such pairs do not touch
    one another, and taking them together gives what taking them in turn gives.
    """
    s = sizes.select("thread_id", "article_count")
    p = pairs.join(s.select(F.col("thread_id").alias("id_1"), F.col("article_count").alias("n1")), "id_1").join(s.select(F.col("thread_id").alias("id_2"), F.col("article_count").alias("n2")), "id_2")
    first = F.col("n1") >= F.col("n2")
    p = p.select("id_1", "id_2", F.struct("method", (-F.col("sim")).alias("s"), "id_1", "id_2").alias("o"), F.when(first, F.col("id_2")).otherwise(F.col("id_1")).alias("gone"), F.when(first, F.col("id_1")).otherwise(F.col("id_2")).alias("kept"))
    p = materialize(p, "merge")
    done = None
    while not p.isEmpty():
        ends = p.select(F.col("id_1").alias("t"), "o").union(p.select("id_2", "o")).groupBy("t").agg(F.min("o").alias("m"))
        m1, m2 = ends.select(F.col("t").alias("id_1"), F.col("m").alias("m1")), ends.select(F.col("t").alias("id_2"), F.col("m").alias("m2"))
        now = materialize(p.join(m1, "id_1").join(m2, "id_2").where("o = m1 AND o = m2").select("gone", "kept", "id_1", "id_2"), "merge")
        done = now if done is None else done.union(now)
        dead = now.select("gone")
        p = p.join(dead, p.id_1 == dead.gone, "left_anti").join(dead, p.id_2 == dead.gone, "left_anti").join(now.select("id_1", "id_2"), ["id_1", "id_2"], "left_anti")
        p = materialize(p, "merge")
    return (done if done is not None else p).select("gone", "kept")


def lifecycle(threads: DataFrame, as_of: Column) -> DataFrame:
    """New status by silence; what is to be deleted is left out. threads: last_seen, status, importance, article_count."""
    silence = (F.unix_micros(as_of) - F.unix_micros("last_seen")) / 3.6e9
    status = F.when(silence > 168, "resolved").when(silence > 72, "dormant").otherwise(F.col("status"))
    out = threads.withColumn("status", status)
    return out.where(~((F.col("status") == "resolved") & (F.col("importance") < 5) & (silence > 720)) & (F.col("article_count") > 0))


def merge_threads(threads: DataFrame, links: DataFrame, target: int, others: list[int]) -> DataFrame:
    """The one row that the target and others become: first and last seen, distinct articles of all, keys.

    threads may have merged_keys from merges before; links: thread_id, article_id.
    """
    t = threads.where(F.col("thread_id").isin(target, *others))
    keys = F.array("thread_key") if "merged_keys" not in threads.columns else F.concat(F.array("thread_key"), F.coalesce("merged_keys", F.array().cast("array<string>")))
    one = t.agg(F.lit(target).alias("thread_id"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(keys)))).alias("merged_keys"))
    n = links.where(F.col("thread_id").isin(target, *others)).agg(F.lit(target).alias("thread_id"), F.countDistinct("article_id").alias("article_count"))
    return one.join(n, "thread_id")


def agreements(rows: DataFrame, per_group: int = 5) -> DataFrame:
    """rows (event_key, title, published_at, action_level; url, source, event_type if there): cards by key, newest first.

    A card: key, type of its first row by time, highest level, first and last time, total, its newest articles.
    """
    there = [c for c in ("published_at", "title", "url", "source") if c in rows.columns]
    keyed = rows.withColumn("event_key", F.trim(F.coalesce("event_key", F.lit("")))).where("event_key <> ''")
    kind = [F.min_by("event_type", "published_at").alias("event_type")] if "event_type" in rows.columns else []
    g = keyed.groupBy("event_key").agg(*kind, F.max(F.coalesce("action_level", F.lit(0))).alias("max_level"), F.count("*").alias("total"), F.min("published_at").alias("first"), F.max("published_at").alias("last"))
    place = F.row_number().over(Window.partitionBy("event_key").orderBy(F.desc("published_at"), "title"))
    top = keyed.withColumn("place", place).where(F.col("place") <= per_group)
    items = top.groupBy("event_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*there).alias("item")))), lambda s: s["item"]).alias("items"))
    return g.join(items, "event_key").orderBy(F.desc("last"), "event_key")


def duplicate_pairs(threads: DataFrame, links: DataFrame, vectors: DataFrame, rule: str, as_of: Column) -> DataFrame:
    """(id_1, id_2, method, sim) of threads of one country that may be one: each pair by the first method that gives it.

    Methods in order: 0 both names match the rule and were seen within 14 days (0.95); 1 at least three and 70 % of the
    smaller one's articles shared, seen within 21 days; 2 mean vectors' cosine over 0.8; 3 keys' similarity over 0.4;
    4 titles' similarity over 0.35. threads: thread_id, country_code, thread_key, title, status, article_count,
    last_seen; vectors: thread_id, country_code, embedding. Resolved threads are left out.
    """
    t = threads.where("status <> 'resolved'")
    seen = F.coalesce("last_seen", as_of)
    named = t.where(F.lower(F.concat_ws(" ", "thread_key", "title")).rlike(rule)).select("thread_id", "country_code", F.unix_micros(seen).alias("us"))
    a, b = named.alias("a"), named.alias("b")
    near = (F.col("a.country_code") == F.col("b.country_code")) & (F.col("a.thread_id") < F.col("b.thread_id")) & (F.abs(F.col("a.us") - F.col("b.us")) < 1209600 * 1000000)
    pair = lambda df, k, sim: df.select("id_1", "id_2", F.lit(k).alias("method"), sim.cast("double").alias("sim"))
    by_rule = pair(a.join(b, near).select(F.col("a.thread_id").alias("id_1"), F.col("b.thread_id").alias("id_2")), 0, F.lit(0.95))
    of = lambda x: t.select(F.col("thread_id").alias(f"id_{x}"), F.col("country_code").alias(f"c{x}"), F.col("article_count").alias(f"n{x}"), F.unix_micros(seen).alias(f"us{x}"))
    shared = shared_articles(links).join(of(1), "id_1").join(of(2), "id_2").withColumn("sim", F.col("both") / F.greatest(F.least("n1", "n2"), F.lit(1)))
    by_overlap = pair(shared.where((F.col("c1") == F.col("c2")) & (F.col("both") >= 3) & (F.col("sim") >= 0.7) & (F.abs(F.col("us1") - F.col("us2")) < 1814400 * 1000000)), 1, F.col("sim"))
    live = vectors.join(t.select("thread_id"), "thread_id", "left_semi")
    by_vector = pair(cosine_join(live, "thread_id", "embedding", 0.8, ["country_code"]), 2, F.col("cos"))
    by_key = pair(trigram_join(t, "thread_id", "thread_key", 0.4, ["country_code"]), 3, F.col("sim"))
    by_title = pair(trigram_join(t, "thread_id", "title", 0.35, ["country_code"]), 4, F.col("sim"))
    every = by_rule.union(by_overlap).union(by_vector).union(by_key).union(by_title)
    return every.groupBy("id_1", "id_2").agg(F.min(F.struct("method", "sim")).alias("m")).select("id_1", "id_2", "m.method", "m.sim")


def auto_merges(pairs: DataFrame, sure: float = 0.8, judge=None) -> DataFrame:
    """The pairs to merge: those from `sure` up, and of the others those that judge (a function of the table) keeps."""
    out = pairs.where(F.col("sim") >= sure)
    return out if judge is None else out.unionByName(judge(pairs.where(F.col("sim") < sure)))
