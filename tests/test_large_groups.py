"""Queries whose groups are large: what their plans compare, and their rows against plain loops."""

import random

import pytest

from lakepress.operators import crowd, dedup
from lakepress.plans import catalog

SF = "/root/testdata/sf0.001"



def test_pairs_of_a_source_meet_by_bins_of_ids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(crowd, "audience_split", lambda pairs, as_of: seen.append(pairs) or pairs)
    catalog.QUERIES["E39_audience_split"](spark, SF)
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan
    view = catalog.run_sql(spark, SF, "SELECT * FROM pairs_")
    assert sorted(map(repr, seen[0].select(*view.columns).collect())) == sorted(map(repr, view.collect()))


@pytest.mark.parametrize("frequent", [0, 20, 10**6])
def test_same_title_of_many_articles(spark, monkeypatch, frequent):
    monkeypatch.setattr(dedup, "FREQUENT", frequent)
    rng = random.Random(1)
    rows = [(i, rng.choice(["a title of more than twenty", "a title of more than twenty", f"another one of more, {i % 40}", "short", None]), rng.choice(["x", "y", "z", None]), rng.randrange(600000)) for i in range(500)]
    df = spark.createDataFrame(rows, "article_id long, title string, source_id string, at_s long")
    want = {}
    for i, t, s, at in rows:
        found = [j for j, u, r, b in rows if t and u == t and len(t) > 20 and s and r and r != s and abs(at - b) <= 86400 and j < i]
        if found:
            want[i] = min(found)
    assert {r.article_id: r.first_id for r in dedup.same_title(df).collect()} == want and len(want) > 100


@pytest.mark.parametrize("portion", [1, 8, 64])
def test_links_of_posts_equal_all_pairs(spark, monkeypatch, portion):
    monkeypatch.setattr(crowd, "PORTION", portion)
    rng = random.Random(portion)
    word = lambda: rng.choice(["minister", "town", "came", "north", "gas", "deal", "court", "день"])
    text = lambda n: " ".join(word() for _ in range(n))
    posts = [(i, rng.choice(["ab", "abc", "q", "", None]), rng.choice([text(3), text(8), "", "!!", None]), rng.randrange(900000)) for i in range(60)]
    arts = [(i, rng.choice([text(2), text(9), "?", None]), rng.choice(["http://x", "http://t.me/abc/7", "t.me/t.me/q", "t.me/", None]) if i % 9 == 0 else "http://x", rng.randrange(900000) // 50000 * 50000) for i in range(90)]
    got = crowd.link_posts(spark.createDataFrame(posts, "post_id long, channel string, text string, at_s long"), spark.createDataFrame(arts, "article_id long, title string, url string, at_s long"))
    got = {r.post_id: r.article_id for r in got.collect()}
    grams = lambda s: {f"  {w} "[i : i + 3] for w in (s or "").replace("!", " ").replace("?", " ").split() for i in range(len(w) + 1)}
    want = {}
    for i, channel, t, at in posts:
        g, found = grams((t or "")[:100]), []
        for j, title, url, b in arts:
            h = grams(title)
            like = bool(g | h) and len(g & h) / len(g | h) >= 0.3
            if t and at - 172800 <= b <= at + 86400 and (like or (channel is not None and f"t.me/{channel}" in (url or ""))):
                found.append((b, -j))
        if found:
            want[i] = -max(found)[1]
    assert got == want and len(want) > 20
