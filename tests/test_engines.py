"""Edges and thresholds by hand-made rows."""

import datetime as dt
import math

from pyspark.sql import functions as F

from lakepress.functions import similarity, text
from lakepress.operators import crowd, dedup, health, relations, signals, temperature, threads
from lakepress.operators.graph import connected_components
from lakepress.sources import feeds, sinks

AT = dt.datetime(2024, 1, 31)


def now():
    return F.lit(str(AT)).cast("timestamp")


STAR = "country_code string, source_id long, tier string, weight double, article_id long, is_relevant boolean, sentiment double, event_type string, action_level long, event_key string, reprint_count long, is_backfill boolean, published_at timestamp"


def row(i, **k):
    base = dict(country_code="a", source_id=i, tier="official", weight=1.0, article_id=i, is_relevant=True, sentiment=1.0, event_type="economic", action_level=1, event_key=None, reprint_count=0, is_backfill=False, published_at=AT - dt.timedelta(hours=1))
    return tuple((base | k).values())


def test_temperature_cases(spark):
    df = spark.createDataFrame([row(1, event_key="treaty", sentiment=3.0), row(2, event_key="treaty", sentiment=0.0), row(3, is_backfill=True, sentiment=-3.0), row(4, country_code="b", sentiment=None)], STAR)
    got = {r.country_code: r for r in temperature.temperature(df, now()).collect()}
    assert set(got) == {"a"}
    assert got["a"].temperature == round(3.0 / 1.2 * 100 / 3, 1) and got["a"].n_articles == 2
    assert temperature.temperature(df.limit(0), now()).count() == 0


def test_temperature_against_a_loop(spark):
    rows = [row(i, country_code="ab"[i % 2], sentiment=(i % 7 - 3) / 1.0, event_key=[None, "one thing", "x"][i % 3], weight=[0.5, 1.0, None][i % 3], action_level=i % 8, reprint_count=i % 4, published_at=AT - dt.timedelta(hours=7 * i)) for i in range(1, 60)]
    got = {r.country_code: r.temperature for r in temperature.temperature(spark.createDataFrame(rows, STAR), now()).collect()}
    names = [x.split()[0] for x in STAR.split(", ")]
    for c in "ab":
        seen, num, den = {}, 0.0, 0.0
        live = [dict(zip(names, r, strict=True)) for r in rows]
        live = [r for r in live if r["country_code"] == c and (AT - r["published_at"]).days < 14]
        for r in sorted(live, key=lambda r: (-(r["weight"] or -1), r["article_id"])):
            key = r["event_key"] if r["event_key"] and len(r["event_key"]) > 3 else r["article_id"]
            k = seen[key] = seen.get(key, -1) + 1
            w = (r["weight"] or 1.0) * math.exp(-(AT - r["published_at"]).total_seconds() / 1209600) * (1 + math.log(1 + r["reprint_count"])) * temperature.ACTION.get(r["action_level"], 1) * 0.2**k
            num, den = num + r["sentiment"] * w, den + abs(w)
        assert abs(got[c] - num / den * 100 / 3) < 0.051


def test_levels_at_their_bounds(spark):
    s = spark.createDataFrame([(45.0,), (44.9,), (15.0,), (-15.0,), (-15.1,), (-40.0,), (-70.0,), (-70.1,)], "s double")
    assert [r[0] for r in s.select(relations.level(F.col("s"))).collect()] == ["ally", "partner", "partner", "neutral", "cooling", "cooling", "tension", "hostile"]


def test_suppression_at_the_ttl(spark):
    e = spark.createDataFrame([("k", 0), ("k", 9), ("k", 10), ("k", 19), ("k", 21), ("j", 5)], "dedup_key string, at_s long")
    assert sorted(map(tuple, signals.suppress_history(e, 10).collect())) == [("j", 5), ("k", 0), ("k", 10), ("k", 21)]


def test_citations(spark):
    cases = [
        ("Rost otnoshenij [1] i spad [2].", [1, 2, 3], "Rost otnoshenij [1] i spad [2].", [1, 2]),
        ("Fakt [1], vydumka [9].", [1, 2], "Fakt [1], vydumka .", [1]),
        ("Prosto tekst bez snosok.", [1], "Prosto tekst bez snosok.", []),
        ("Sobytie [10][11], eshche [2]", [2, 10, 11], "Sobytie [10][11], eshche [2]", [2, 10, 11]),
        ("A [1] B [99] C", [1], "A [1] B C", [1]),
        ("X [0] Y", [0], "X Y", []),
        ("Рост напряжённости [1] и спад [7].", [1], "Рост напряжённости [1] и спад .", [1]),
    ]
    df = spark.createDataFrame(cases, "c string, v array<int>, content string, used array<int>")
    for r in df.select("*", text.apply_citations(F.col("c"), F.col("v")).alias("x"), text.used_citations(F.col("c"), F.col("v")).alias("y")).collect():
        assert r.x == r.content and r.y == r.used


def test_agreements(spark):
    rows = [("gas deal", "t1", "2024-06-01", 3), ("gas deal", "t2", "2024-06-02", 4), ("summit", "t3", "2024-06-05", 2), ("", "t4", "2024-06-06", 1), (None, "t5", "2024-06-06", 1)]
    got = threads.agreements(spark.createDataFrame(rows, "event_key string, title string, published_at string, action_level int")).collect()
    assert [(r.event_key, r.max_level, r.total) for r in got] == [("summit", 2, 1), ("gas deal", 4, 2)]
    many = spark.createDataFrame([("k", f"t{i}", f"2024-06-0{i + 1}", 1) for i in range(8)], "event_key string, title string, published_at string, action_level int")
    one = threads.agreements(many, 3).first()
    assert one.total == 8 and [i.title for i in one["items"]] == ["t7", "t6", "t5"]


def test_text(spark):
    t = lambda s, f: spark.createDataFrame([(s,)], "s string").select(f(F.col("s"))).first()[0]
    assert t("Привет, Мир!  2", text.normalize_title) == "привет мир 2"
    assert t("404", text.clean_title) is None and t("Error in the long title", text.clean_title) is None
    assert t("Переговоры прошли успешно | РИА Новости", text.clean_title) == "Переговоры прошли успешно"
    assert t("A &laquo;good&raquo;   long title", text.clean_title) == "A «good» long title"
    assert t("Визит Vance в Баку", text.normalize_event_key) == "визит вэнс баку"
    assert t("Молния", text.detect_language) == "ru" and t("Hello world", text.detect_language) == "en"
    assert t("x\n*Bold* headline here\nmore", text.extract_title) == "Bold headline here"
    assert t("https://feeds.www.site.com/a", text.base_domain) == "www.site.com"
    assert t("see [a](http://x) b", text.strip_links) == "see a b"
    topics = spark.createDataFrame([(["Energy", "bad", "economy-trade", "ENERGY", "culture sport", "finance"],)], "t array<string>")
    assert topics.select(text.validate_topics(F.col("t"))).first()[0] == ["energy", "economy_trade", "culture_sport"]
    assert t('say {"a": 1} ok', text.extract_json) == '{"a": 1}' and t("no", text.extract_json) is None


def test_similarity(spark):
    df = spark.createDataFrame([("word", "two words")], "a string, b string")
    s = df.select(similarity.trigram_similarity(similarity.trigrams(F.col("a")), similarity.trigrams(F.col("b")))).first()[0]
    assert abs(s - 0.363636) < 1e-5
    docs = [(i, f"the quick brown fox {i % 3} jumps over {i}") for i in range(12)] + [(99, None), (98, "")]
    df = spark.createDataFrame(docs, "id long, t string")
    got = {(r.id_1, r.id_2): round(r["sim"], 9) for r in similarity.trigram_join(df, "id", "t", 0.8).collect()}

    def grams(s):
        return {f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)}

    want = {(a, b): round(len(grams(s) & grams(u)) / len(grams(s) | grams(u)), 9) for a, s in docs[:12] for b, u in docs[:12] if a < b}
    assert got == {k: v for k, v in want.items() if v > 0.8}


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (4, 5), (7, 7), (None, 1)] + [(i, i + 1) for i in range(100, 140)], "u long, v long")
    got = {r.node: r.component for r in connected_components(e).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 5)} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert {got[k] for k in range(100, 141)} == {100} and 7 not in got
    assert connected_components(e.limit(0)).count() == 0


def test_retrospective_is_not_components(spark):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [(1, base, 0, "x"), (2, base.replace("mu", "mo"), 1, "x"), (3, base.replace("mu", "mo").replace("kappa", "koppa"), 2, "x")]
    df = spark.createDataFrame(rows, "article_id long, title string, at_s long, country_code string")
    got = {r.article_id: r.parent_id for r in dedup.retrospective(df, above=0.9).collect()}
    assert got == {2: 1}  # 3 is like 2 only, and 2 is a duplicate


def test_merge_in_order(spark):
    p = spark.createDataFrame([(1, 2, 1, 0.9), (2, 3, 1, 0.8), (3, 4, 2, 0.7)], "id_1 long, id_2 long, method int, sim double")
    s = spark.createDataFrame([(1, 5), (2, 4), (3, 3), (4, 9)], "thread_id long, article_count long")
    assert sorted(map(tuple, threads.merge_in_order(p, s).collect())) == [(2, 1), (3, 4)]


def test_health_states(spark):
    src = spark.createDataFrame([(i, "a", "official", True) for i in range(4)], "source_id long, country_code string, tier string, active boolean")
    at = lambda h: AT - dt.timedelta(hours=h)
    art = spark.createDataFrame([(0, 1, at(3)), (0, 2, at(2)), (0, 3, at(1)), (1, 4, at(10)), (1, 5, at(11)), (2, 6, at(168)), (2, 7, at(300))], "source_id long, article_id long, published_at timestamp")
    got = {r.source_id: (r.expected_h, r.state) for r in health.source_health(src, art, now()).collect()}
    assert got == {0: (3.0, "OK"), 1: (3.0, "STALE"), 2: (72.0, "STALE"), 3: (72.0, "DEAD")}


def test_sinks(spark):
    old = spark.createDataFrame([(1, 10, 5), (2, 20, 6)], "k int, a int, b int")
    new = spark.createDataFrame([(2, None, 9), (3, 30, 7)], "k int, a int, b int")
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(sinks.upsert(old, new, ["k"])) == [(1, 10, 5), (2, None, 9), (3, 30, 7)]
    assert rows(sinks.upsert_keep(old, new, ["k"])) == [(1, 10, 5), (2, 20, 9), (3, 30, 7)]
    assert rows(sinks.upsert_span(old, new, ["k"], "a", "b")) == [(1, 10, 5), (2, 20, 9), (3, 30, 7)]
    assert rows(sinks.insert_absent(old, new, ["k"])) == [(1, 10, 5), (2, 20, 6), (3, 30, 7)]


def test_feeds(spark):
    xml = "<rss><channel><item><title> A  b </title><link>http://x/1</link><description>&lt;p&gt;Hi&lt;/p&gt; there</description><pubDate>Mon, 29 Jan 2024 10:00:00 +0000</pubDate></item><item><title>No link</title></item></channel></rss>"
    got = feeds.rss(spark.createDataFrame([(xml,)], "x string"), "x", now()).collect()
    assert [(r.external_id, r.title, r.body) for r in got] == [("http://x/1", "A b", "Hi there"), ("No link", "No link", None)]
    assert got[0].published_at == dt.datetime(2024, 1, 29, 10) and got[1].published_at == AT
    sm = "<urlset><url><loc>u1</loc><lastmod>2021-05-01</lastmod></url><url><loc>u2</loc></url><url><loc>u3</loc><lastmod>2023-01-01</lastmod></url></urlset>"
    assert [r.loc for r in feeds.sitemap(spark.createDataFrame([(sm,)], "x string"), "x").collect()] == ["u2", "u3"]


def test_stream_matches_batch_and_forgets(spark, tmp_path):
    from lakepress.streaming import ingest

    rows = [("k", 5000 + t) for t in (0, 4, 12, 13, 30)] + [("j", 5002)]  # rows at the first watermark, 0, would be late
    df = spark.createDataFrame(rows, "dedup_key string, at_s long")
    timed = df.select("dedup_key", F.timestamp_seconds("at_s").alias("published_at"))
    timed.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(timed.schema).parquet(f"{tmp_path}/in")
    out = ingest.suppressed(stream, 10)
    write = lambda df, e: df.write.mode("append").parquet(f"{tmp_path}/out")
    ingest.drain(out, write, f"{tmp_path}/cp").awaitTermination()
    read = lambda: sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect()))
    assert read() == sorted(map(tuple, signals.suppress_history(df, 10).collect())) == [("j", 5002), ("k", 5000), ("k", 5012), ("k", 5030)]
    # a much later event moves the watermark on; the keys before it are forgotten
    later = spark.createDataFrame([("z", 100_000)], "dedup_key string, at_s long").select("dedup_key", F.timestamp_seconds("at_s").alias("published_at"))
    later.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = ingest.drain(out, write, f"{tmp_path}/cp")
    query.awaitTermination()
    assert ("z", 100_000) in read()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1


def test_long_suppression_history(spark):
    """One hot key: its events are gone through by batches."""
    e = spark.range(200_000).select(F.lit("k").alias("dedup_key"), F.col("id").alias("at_s"))
    got = [r.at_s for r in signals.suppress_history(e, 1000).orderBy("at_s").collect()]
    assert got == list(range(0, 200_000, 1000))


def test_escalation_and_shift(spark):
    """Both follow the articles in order; null levels are 1, null sentiments do not count."""
    def one(levels, sents):
        df = spark.createDataFrame([row(i, event_key="k", action_level=a, sentiment=s, published_at=AT - dt.timedelta(hours=10 - i)) for i, (a, s) in enumerate(zip(levels, sents, strict=True))], STAR)
        return threads.importance(df, now()).first()

    base = one([2, 2], [1.0, 1.0])
    assert abs(base.importance - 3 * math.log(3) * 2 * math.log10(3) * 1.5 * (1 - 9 / 168)) < 0.006
    assert abs(one([1, 4], [1.0, 1.0]).importance / one([4, 4], [1.0, 1.0]).importance - 4) < 0.01  # 4 / 1, not 1.3
    assert abs(one([None, 4], [1.0, 1.0]).importance / one([4, 1], [1.0, 1.0]).importance - 4) < 0.01
    assert one([1] * 5, [1.0, None, 2.0, 3.0, -1.2345]).sentiment_shift == -2.235 or one([1] * 5, [1.0, None, 2.0, 3.0, -1.2345]).sentiment_shift == -2.234
    assert one([1] * 4, [1.0, None, 2.0, 3.0]).sentiment_shift == 0.0


def test_resonance_cases(spark):
    day = lambda n: AT - dt.timedelta(days=n)
    rows = [row(i, event_key="quake", action_level=3, published_at=day(12)) for i in range(3)] + [row(10 + i, event_key="abc", published_at=day(1)) for i in range(9)]
    rows += [row(20 + i, event_key="old1", published_at=day(15)) for i in range(5)] + [row(30 + i, event_key="курс валют", published_at=day(1)) for i in range(5)] + [row(40 + i, event_key="null", sentiment=None, published_at=day(1)) for i in range(5)]
    got = threads.resonance(spark.createDataFrame(rows, STAR), now()).collect()
    assert [(r.event_key, r.n, r.resonance) for r in got] == [("quake", 3, round(2 * math.log(4) * 1.5 * 0.8 * 1.5 * 1.2, 1))]


def test_signal_cases(spark):
    hour = lambda n: AT - dt.timedelta(hours=n)
    rows = [row(i, tier=t, event_key="deal", action_level=4, published_at=hour(1)) for i, t in enumerate(("official", "social", "analytics"))]
    got = signals.tier_convergence(spark.createDataFrame(rows, STAR), now()).first()
    assert (got.severity, got.confidence, got.dedup_key, got.ttl_h) == ("warning", 0.8, "tier_convergence:a:deal", 24)
    loud = [row(i, tier=t, event_key="deal", published_at=hour(7 + i)) for i, t in enumerate(("social", "independent", "analytics", "western_proxy"))]
    src = spark.createDataFrame([("a", "official", True)], "country_code string, tier string, active boolean")
    silent = signals.official_silence(spark.createDataFrame(loud, STAR), src, now()).first()
    assert (silent.confidence, silent.dedup_key) == (0.7, "official_silence:a:deal")  # analytics is neither loud nor quiet
    assert signals.official_silence(spark.createDataFrame(loud[:3], STAR), src, now()).count() == 0
    # one signal for a key of two countries; no anchor, no signal; demoted countries are never critical
    notes = [row(1, event_key="war", action_level=6, event_type="military", published_at=hour(2)), row(2, event_key="war", country_code="b", action_level=6, event_type="military", published_at=hour(1)), row(3, event_key="gas", country_code="b", action_level=6, event_type="economic", published_at=hour(1)), row(4, event_key="mud", action_level=6, event_type="economic", published_at=hour(1))]
    star = spark.createDataFrame(notes, STAR).withColumn("title", F.when(F.col("event_key") == "mud", "nothing").otherwise("Союз")).withColumn("body", F.lit(None).cast("string"))
    got = {r.dedup_key: (r.country_code, r.severity, r.confidence) for r in signals.notable_event(star, now(), ("b",)).collect()}
    assert got == {"notable:war": ("b", "warning", 0.9), "notable:gas": ("b", "warning", 0.9)}
    # shares: the newest at least twice the mean of the third newest and older ones, thirteen of them at least
    days = [("a", AT.date() - dt.timedelta(days=k), 20, 0.4 if k == 1 else 0.9 if k == 2 else 0.1, 0.0) for k in range(1, 15)]
    surge = lambda rows: signals.volume_surge(spark.createDataFrame(rows, "country_code string, day date, volume long, share double, tone double"), now()).collect()
    assert [(r.severity, r.confidence, r.dedup_key) for r in surge(days)] == [("warning", 0.75, "volume_surge:a:20240131")]
    assert surge(days[:13]) == [] and surge([(*d[:2], 9, *d[3:]) for d in days]) == [] and surge([(*d[:4], None) if k == 5 else d for k, d in enumerate(days)]) == []
    fx = spark.createDataFrame([("x", AT.date() - dt.timedelta(days=k), c) for k, c in ((1, -2.5), (2, 9.0))] + [("y", AT.date() - dt.timedelta(days=3), 5.0)], "currency string, day date, chg double")
    zones = spark.createDataFrame([("x", "a", 0), ("x", "b", 1), ("y", "b", 0)], "currency string, country_code string, place int")
    live = spark.createDataFrame([("tone_shift", "b", hour(71)), ("tier_convergence", "a", hour(1)), ("volume_surge", "a", hour(73))], "signal_type string, country_code string, created_at timestamp")
    assert [(r.country_code, r.severity, r.confidence, r.dedup_key) for r in signals.fx_move(fx, zones, live, now()).collect()] == [("a", "info", 0.8, "fx_move:x:2024-01-30")]
    assert signals.fx_move(fx, zones, live.limit(0), now()).first().confidence == 0.65
    pressure = spark.createDataFrame([("a", 130, 30, hour(47)), ("b", 130, 30, hour(49)), ("c", 130, 30, hour(1)), ("a", 54, 30, hour(1))], "country_code string, total long, previous long, updated_at timestamp")
    got = signals.sanctions_escalation(pressure, spark.createDataFrame([("a",), ("b",)], "country_code string"), now()).collect()
    assert [(r.severity, r.confidence, r.dedup_key) for r in got] == [("warning", 0.7, "sanctions_escalation:a:202401")]


def test_signals_expire(spark):
    s = spark.createDataFrame([("k", "a", 24, 0.5, "s")], "dedup_key string, country_code string, ttl_h int, confidence double, subject string")
    at = lambda h: F.lit(str(AT - dt.timedelta(hours=h))).cast("timestamp")
    assert signals.suppress(s, signals.stored(s, at(23)), now()).count() == 0 and signals.suppress(s, signals.stored(s, at(24)), now()).count() == 1
    assert signals.clean_up(signals.stored(s, at(24 * 31)), now()).count() == 1 and signals.clean_up(signals.stored(s, at(24 * 31 + 1)), now()).count() == 0


def test_verdict(spark):
    def verdict(ok, dead, news):
        h = spark.createDataFrame([(i, "a", "official", "OK" if i < ok else "DEAD") for i in range(ok + dead)], "source_id int, country_code string, tier string, state string")
        return health.overall_verdict(h, spark.createDataFrame([(news,)], "state string")).first().verdict

    assert [verdict(8, 2, "OK"), verdict(8, 2, "STALE"), verdict(6, 4, "OK"), verdict(4, 6, "OK"), verdict(3, 7, "OK"), verdict(0, 0, "OK")] == ["HEALTHY", "WARNING", "WARNING", "DEGRADED", "UNHEALTHY", "UNHEALTHY"]


def test_audience_split_cases(spark):
    cols = "source_id long, country_code string, article_id_1 long, article_id_2 long, detected_at timestamp, lang_1 string, lang_2 string, sent_1 double, sent_2 double, sentiment_delta double"
    rows = [(1, "a", 1, 2, AT, "ru", "kk", 1.0, 0.5, 0.5), (1, "a", 3, 4, AT, None, "kk", None, 1.0, 1.0), (2, "a", 5, 6, AT, "en", None, 2.0, -1.0, 3.0), (3, "b", 7, 8, AT - dt.timedelta(days=31), "ru", "en", 3.0, 0.0, 3.0)]
    got = {r.source_id: r for r in crowd.audience_split(spark.createDataFrame(rows, cols), now()).collect()}
    assert set(got) == {1, 2}
    assert (got[1].lang_1, got[1].lang_2, got[1].mean_1, got[1].mean_2, got[1].delta, got[1].significant) == ("kk", "ru", 0.75, 0.5, 0.25, False)
    assert (got[2].lang_1, got[2].lang_2, got[2].delta, got[2].significant) == ("en", None, 3.0, True)


def test_reprints_one_by_one(spark):
    """Against the sequential rule, with the most similar one that is no duplicate."""
    import random

    r = random.Random(3)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()
    rows = []
    for i in range(60):
        w = list(words[: r.choice((11, 12))])
        for _ in range(r.choice((0, 1, 1, 2))):
            w[r.randrange(len(w))] = r.choice(("omega", "sigma", "tau"))
        rows.append((i, " ".join(w).title() + "!", r.randrange(0, 300_000), "x"))

    def grams(s):
        s = "".join(c for c in s.lower() if c.isalnum() or c == " ")
        return {f"  {w} "[i : i + 3] for w in s.split() for i in range(len(w) + 1)}

    def sim(a, b):
        return len(grams(a) & grams(b)) / len(grams(a) | grams(b))

    best, first = {}, {}
    for i, t, at, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        before = [(j, sim(t, u), s) for j, u, s, _ in rows if (s, j) < (at, i)]
        near = [(-x, j) for j, x, s in before if x > 0.85 and at - s <= 172800 and j not in best]
        if near:
            best[i] = min(near)[1]
        like = [(s, j) for j, x, s in before if x > 0.85 and j not in first]
        if like:
            first[i] = min(like)[1]
    df = spark.createDataFrame(rows, "article_id long, title string, at_s long, country_code string")
    assert {x.article_id: x.parent_id for x in dedup.best_parent(df).collect()} == best and best
    assert {x.article_id: x.parent_id for x in dedup.retrospective(df).collect()} == first and first


def test_cosine_join_equals_all_pairs(spark):
    import random

    r = random.Random(5)
    centres = [[r.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    vecs = [(i, i % 2, [c + r.gauss(0, 0.3) for c in centres[i % 5]]) for i in range(80)] + [(900, 0, [0.0] * 8)]
    df = spark.createDataFrame(vecs, "id long, part long, v array<double>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b) or 1)

    for above in (0.2, 0.9):
        want = {(a, b) for a, p, x in vecs for b, q, y in vecs if a < b and p == q and cos(x, y) > above}
        assert {(x.id_1, x.id_2) for x in similarity.cosine_join(df, "id", "v", above, ["part"]).collect()} == want
    assert similarity.cosine_join(df.limit(0), "id", "v", 0.5).count() == 0


def test_landed_feeds(spark):
    one = lambda s: spark.createDataFrame([(s,)], "x string")
    atom = '<feed><entry><title>A</title><link href="http://x/1"/><summary>&lt;b&gt;Hi&lt;/b&gt;</summary><published>2024-01-29T10:00:00Z</published></entry><entry><title>B</title><link href="http://x/2"/><content>c</content><updated>2024-01-28T10:00:00Z</updated></entry></feed>'
    got = feeds.atom(one(atom), "x", now()).collect()
    assert [(r.external_id, r.title, r.body, r.published_at) for r in got] == [("http://x/1", "A", "Hi", dt.datetime(2024, 1, 29, 10)), ("http://x/2", "B", "c", dt.datetime(2024, 1, 28, 10))]
    lists = '[{"name":"a","collections":["sanctions"],"publisher":{"country":"fr"},"target_count":3,"last_change":"2024-01-02T00:00"},{"name":"b","collections":["sanctions"],"publisher":{"country":"FR"},"target_count":null},{"name":"c","collections":["pep"],"publisher":{"country":"fr"}},{"name":"d","collections":["sanctions"],"publisher":{"country":"eu1"}},{"name":"e","collections":["sanctions"]}]'
    got = feeds.sanction_lists(one(lists), "x").collect()
    assert [(r.cc, r.lists_count, r.target_count, r.last_change, [p["name"] for p in r.programs]) for r in got] == [("FR", 2, 3, "2024-01-02", ["a", "b"])]
    text_of = lambda s: one(s).select(text.unescape(F.col("x"))).first()[0]
    assert text_of("&#8217;&eacute;&#x41;&amp;lt;&nope;&#1114112;&amp;&euro;&#0;") == "’éA&lt;&nope;&#1114112;&€&#0;"


def test_fetching(spark):
    index = "<sitemapindex><sitemap><loc>a</loc><lastmod>2021-01-01</lastmod></sitemap><sitemap><loc>b</loc></sitemap><sitemap><loc>c</loc><lastmod>2024-01-01</lastmod></sitemap></sitemapindex>"
    assert [r.loc for r in feeds.sitemap_children(spark.createDataFrame([(index,)], "x string"), "x").collect()] == ["b", "c"]
    tries = [(1, 1, "ok"), (1, 2, "timeout"), (2, 1, "timeout"), (2, 2, "ok"), (3, 1, "http_4xx"), (4, 1, "timeout"), (4, 2, "timeout"), (4, 3, "http_5xx"), (5, 1, "http_4xx"), (5, 2, "conn_error"), (6, 1, "ok"), (6, 2, "http_5xx")]
    assert sorted(map(tuple, feeds.to_fetch_again(spark.createDataFrame(tries, "source_id long, at int, outcome string")).collect())) == [(6, 1)]
    rows = [("x", d, float(d)) for d in range(1, 41)] + [("x", 41, None), ("y", 1, 0.0), ("y", 2, 5.0)]
    got = {r.secid: (r["last"], r.change_pct, len(r.spark)) for r in feeds.index_cards(spark.createDataFrame(rows, "secid string, day int, value double")).collect()}
    assert got == {"x": (40.0, round(29 / 11 * 100, 2), 30), "y": (5.0, None, 2)}


def test_agreement_records(spark):
    rows = [("gas deal", "t1", "u1", "s1", "2024-06-01", 3, "economic"), (" gas deal ", "t2", "u2", "s2", "2024-06-02", None, "diplomatic")]
    one = threads.agreements(spark.createDataFrame(rows, "event_key string, title string, url string, source string, published_at string, action_level int, event_type string")).first()
    assert (one.event_key, one.event_type, one.max_level, one["first"], one["last"], one.total) == ("gas deal", "economic", 3, "2024-06-01", "2024-06-02", 2)
    assert [tuple(i) for i in one["items"]] == [("2024-06-02", "t2", "u2", "s2"), ("2024-06-01", "t1", "u1", "s1")]


def test_merge_counts_distinct_articles(spark):
    th = spark.createDataFrame([(1, "a", AT, AT), (2, "b", AT, AT)], "thread_id long, thread_key string, first_seen timestamp, last_seen timestamp")
    links = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (2, 12)], "thread_id long, article_id long")
    one = threads.merge_threads(th, links, 1, [2]).first()
    assert one.article_count == 3 and one.merged_keys == ["a", "b"]


def test_clusters_of_partly_embedded_countries(spark):
    a, b = [1.0, 0.0, 0.0], [0.9, 0.1, 0.0]
    rows = [
        (5, "A", "Summit In Rome", a), (6, "A", None, b),  # a cosine cluster
        (3, "A", "summit in rome ", None), (4, "A", "summit in rome today", None),  # keys alike; the first is in the cosine cluster
        (7, "A", "grain prices", None), (8, "A", "grain prices", None), (9, "A", "short", None), (10, "A", "прогноз погоды в Риме", None), (11, "A", None, None),
        (12, "A", "other talk", [0.0, 1.0, 0.0]), (13, "A", "прогноз погоды", [0.0, 0.0, 1.0]),
        (20, "B", "summit in rome", None), (21, "B", "визит Трампа", None), (22, "B", "trump визит", None), (23, "B", "визит трамп", None),
        (24, "B", "trump", None), (25, "B", "трампа", None),  # the first has five characters; the second is like визит трампа
        (30, "C", "x", a), (31, "C", "x", b), (32, "C", "y", a),
    ]
    df = spark.createDataFrame(rows, "article_id long, country_code string, event_key string, embedding array<double>")
    got = {r.article_id: r.cluster for r in threads.cluster(df).collect()}
    assert got == {5: 3, 6: 3, 3: 3, 4: 3, 7: 7, 8: 7, 12: 12, 13: 13, 20: 20, 21: 21, 22: 22, 23: 21, 25: 21, 30: 30, 31: 30, 32: 30} | {22: got[22]}
    # by keys alone: at a share that is not exceeded vectors do not count
    n = sum(r[3] is not None or (r[2] is not None and len(r[2].strip()) > 5 and "прогноз" not in r[2]) for r in rows)
    got = {r.article_id: r.cluster for r in threads.cluster(df, embedded_share=7.01 / n).collect()}
    assert got[5] == got[3] == got[4] == 3 and 6 not in got and got[30] == got[31] == got[32] == 30  # x and y have the empty normal form
    assert threads.cluster(df, embedded_share=6.9 / n).where("article_id = 6").count() == 1
    assert threads.cluster(df.limit(0)).count() == 0


def test_links_and_feeds_of_pages(spark):
    long = "a headline of some length"
    html = (
        "<html><head><LINK rel=alternate type='application/rss+xml' href='/f?a=1&amp;b=2'><link type=\"application/atom+xml\" href=\"http://o.org/atom\"><link type='application/rss+xml'><link type='application/rss+xml' href=/third></head>"
        f"<a href=/one>{long}</a><a class=x href='//news.site.com/two'> <b>{long}</b> </a><A HREF=\"http://site.com/one\">{long} again</A><a href=http://other.com/x>{long}</a><a href=rel>{long}</a>"
        f"<a href='/tag/x'>{long}</a><a href='/a.PDF'>{long}</a><a data-href='/no'>{long}</a><a href=/three?x=1&amp;y=2><i>so many</i> <i>letters</i></a><a href=/four>fourteen chars</a><abbr href=/five>{long}</abbr>"
    )
    pages = spark.createDataFrame([(1, "http://site.com/home", html), (2, "http://site.com", None), (3, "https://s.org/", f"<link type=application/rss+xml href=/f><a href=/here>{long}</a>")], "page_id long, url string, html string")
    got = [(r.page_id, r.url) for r in feeds.page_links(pages).orderBy("page_id", "place").collect()]
    assert got == [(1, "http://site.com/one"), (1, "http://news.site.com/two"), (3, "https://s.org/here")]
    assert feeds.page_links(pages, least=14).where("url = 'http://site.com/three?x=1&y=2'").first().anchor == "so manyletters"
    assert [tuple(r) for r in feeds.feed_links(pages).orderBy("page_id", "place").collect()] == [(1, 0, "http://site.com/f?a=1&b=2"), (1, 1, "http://o.org/atom"), (1, 2, "http://site.com/third"), (3, 0, "https://s.org/f")]
    items = spark.createDataFrame([("http://o.org/atom", 0, "http://o.org/1"), ("http://site.com/f?a=1&b=2", 3, "http://site.com/z"), ("http://site.com/third", 0, "http://site.com/never"), ("https://s.org/f", 0, "")], "feed_url string, place int, link string")
    assert sorted(map(tuple, feeds.discover(pages, items).collect())) == [(1, "http://o.org/1"), (1, "http://site.com/z"), (3, "https://s.org/here")]
    assert [tuple(r) for r in feeds.discover(pages, items, 1).where("page_id = 1").collect()] == [(1, "http://site.com/z")]


def test_entries_of_feeds(spark):
    xml = '<rss xmlns:content="c"><channel><item><title>A</title><description>short</description><content:encoded>&lt;p&gt;whole&lt;/p&gt; text</content:encoded></item><item><title> </title><description> </description><link>http://x/2</link></item><item><description>only a body</description></item></channel></rss>'
    got = feeds.rss(spark.createDataFrame([(xml,)], "x string"), "x", now()).collect()
    assert [(r.title or "", r.body) for r in got] == [("A", "whole text"), ("", "only a body")]
