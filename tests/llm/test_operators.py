"""Corpus operators against brute force on small tables, with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from lakepress.llm import bpe, decontaminate, html_text, licenses, ngram_join, pii, quality, shared, token_cache, toxicity, warc
from lakepress.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "sa", "ti") for b in ("", "ba", "do", "fe", "gu")]


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string")


ODD = [None, "", "   \n\t ", "one", "one", "Two words", "x" * 300_000, "é" * 50 + " 中文 ß"]


def brute_components(texts, num, den, n):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and den * both >= num * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            top[y] = x
    return [(len(s), root(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("num,n,frequent", [(85, 4, False), (80, 5, False), (85, 4, True)])
def test_ngram_join(spark, monkeypatch, num, n, frequent):
    if frequent:  # every token is frequent: only combinations are indexed
        width = (1 << ngram_join.CHUNK_BITS) // 8

        def all_marked(hot_rows):
            def run(batches):
                import pyarrow as pa

                salts = zlib.compress(np.full(8 * width, 3, np.uint16).tobytes())  # and every key is hot
                for b in batches:
                    for k in b.column("chunk").to_pylist():
                        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([b"\xff" * width], pa.binary()), pa.array([salts], pa.binary())], names=["chunk", "marks", "salts"])

            return run

        monkeypatch.setattr(ngram_join, "SALT_ROWS", 2)
        monkeypatch.setattr(ngram_join, "_outstanding", all_marked)
    r = random.Random(3)
    base = [prose(i, 120).split() for i in range(6)]
    texts = list(ODD)
    for k in range(70):
        w = list(base[k % 6])
        for _ in range(r.choice((0, 0, 1, 2, 3, 5, 9))):
            w[r.randrange(len(w))] = r.choice(WORDS).upper()
        texts.append(" ".join(w[: r.choice((120, 118, 110))]))
    texts += [prose(1, 9), prose(1, 9) + " end", prose(1, 10), texts[20], texts[20]]
    got = ngram_join.ngram_jaccard_join(frame(spark, texts), n=n, num=num).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == [(i, *x) for i, x in enumerate(brute_components(texts, num, 100, n))]


def test_large_sets_links_equal_brute_force(spark, monkeypatch):
    """Sizes on both sides of a wide sketch's band and near the threshold; keys of more than two entries are hot."""
    monkeypatch.setattr(ngram_join, "HOT_ROWS", 2)
    r = random.Random(11)
    base = [[f"{w}{r.randrange(50)}" for w in prose(i, 1060).split()] for i in range(3)]
    texts = []
    for k in range(30):
        w = list(base[k % 3])[: r.choice((500, 530, 1000, 1060))]
        for _ in range(r.choice((0, 2, 10, 18, 20, 22, 25, 40))):
            w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
        texts.append(" ".join(w))
    got = ngram_join.ngram_jaccard_join(frame(spark, texts)).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == [(i, *x) for i, x in enumerate(brute_components(texts, 85, 100, 4))]


def test_near_duplicate_filter(spark):
    t = prose(5, 60)
    rows = [(1, t), (1, t), (2, t + " more"), (3, "alone in here with words"), (None, t), (4, None), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'a' AS node", "1 AS component_id")
    kept = ngram_join.near_duplicate_filter(df)
    assert kept.columns == df.columns
    assert sorted((x.doc_id or 0, (x.text or "")[:5]) for x in kept.collect()) == sorted([(1, t[:5]), (3, "alone"), (0, t[:5]), (4, ""), (4, "")])
    assert ngram_join.near_duplicate_filter(df.limit(0)).count() == 0


def test_base_spans():
    def brute(text):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
            d = re.sub("[^0-9]", "", m[0])
            if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0:
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
        return out

    r = random.Random(7)
    parts = ["a@b.c", "x.y@z", "@", "..", "1.2.3.4", "256.1.1.1", "4539 1488 0343 6467", "4539148803436467", "+1 (803) 555-5351", "+", "12", ".", "-", " ", "é", "0001.2.3.4", "@a.b@c.d", "a-b@c-d.e-f."]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randint(1, 9)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("1" * 200_000 + "@" + "a" * 200_000) == []


def test_context_finds_new_identifiers(spark):
    texts = [f"please ring hotline +1 803 555 53{i} today {prose(i, 30)}" for i in range(10, 30)]
    texts += ["please ring hotline 803 555 1234 now", "the year 2024 and 803 555 9999 in the wild", None, ""]
    rows, good = pii.find_personal_data(frame(spark, texts))
    got = {x.doc_id: x.spans for x in rows.collect()}
    assert got[20] == "phone:20:32" and got[21] == "" and got[22] == "" and got[10].startswith("phone:20:")
    assert {x.pattern for x in good.collect()} >= {"hotline"}
    clean = pii.without_personal_data(frame(spark, texts)).collect()
    assert sorted(x.text for x in clean if x.doc_id == 20) == ["please ring hotline <PHONE> now"]
    assert pii.find_personal_data(frame(spark, texts).limit(0))[0].count() == 0
    assert pii.mask("abcdef", "ip:1:3,card:2:4") == "a<IP>ef"


def test_found_instances_bootstrap_further(spark):
    """Numbers that a pattern of seeds finds are the only support of another pattern, which finds more."""
    texts = [f"please ring hotline +1 803 555 53{i} today {prose(i, 30)}" for i in range(10, 40)]
    texts += [f"please ring hotline 803 555 12{i} now" for i in range(10, 20)]
    texts += [f"switchboard 803 555 12{i} is open" for i in range(10, 20)] + ["switchboard 803 777 9999 is shut", "x" * 3000 + " 803 777 0000"]
    rows, good = pii.find_personal_data(frame(spark, texts))
    assert {"hotline", "switchboard"} <= {x.pattern for x in good.collect()}
    spans = {x.doc_id: x.spans for x in rows.collect()}
    assert spans[50] == "phone:12:24" and spans[51] == ""
    once, _ = pii.find_personal_data(frame(spark, texts), rounds=1)
    assert {x.doc_id: x.spans for x in once.collect()}[50] == ""
    assert pii.patterns("x" * 500 + " a 1", [503]) == [["a", pii.named("x" * 500 + " a")]]
    # candidates beside many base spans take time in proportion
    many = "a@b.c 803 555 1234 " * 20_000
    base = pii.base_spans(many)
    assert len(base) == 20_000 == len([c for c in pii.candidates(many, base) if c[0] == "phone"])
    long = "a" * 300 + " (at) " + "b" * 100 + " dot"
    assert pii.candidates(long, [])[0] == ("email", 0, 406)


def test_mask_stage_keeps_other_columns(spark):
    t = "mail me at a@b.c now"
    df = spark.createDataFrame([(1, t, 5), (1, t, 5), (1, "clean", 6), (None, t, 7), (2, None, 8)], "doc_id long, text string, spans int").selectExpr("*", "1 AS row_id", "2 AS row_hash", "length(text) AS n_chars")
    out = pii.without_personal_data(df)
    assert out.columns == df.columns
    assert sorted((x.doc_id or 0, x.text or "", x.spans, x.n_chars or 0) for x in out.collect()) == sorted([(1, "mail me at <EMAIL> now", 5, 22), (1, "mail me at <EMAIL> now", 5, 22), (1, "clean", 6, 5), (0, "mail me at <EMAIL> now", 7, 22), (2, "", 8, 0)])


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.BytePairCoder(path)
    r = random.Random(1)
    letters = " \t\n\r\x0b\x85  abAB'sd'll19²½é中😀́-_.!￼"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(1500)] + ["a<|endoftext|>b", "x" * 5000, "   "]
    for t in texts:
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids and own.decode(ids) == lib.decode(ids, skip_special_tokens=False)
    clash = bpe.bpe_encode_decode(frame(spark, ["one"]).withColumn("ids", F.lit(1)), path)
    assert clash.columns == ["doc_id", "text", "n", "ids", "ids_", "n_tokens", "decoded"] and clash.first().ids == 1
    assert bpe.bpe_encode_decode(frame(spark, ODD).limit(0), path).count() == 0
    got = bpe.bpe_encode_decode(frame(spark, ODD), path).select("doc_id", "ids", "n_tokens", "decoded", bpe.ids_digest("ids").alias("h")).collect()
    for x in got:
        t = ODD[x.doc_id] or ""
        assert x.decoded == t and x.ids == lib.encode(t, add_special_tokens=False).ids and x.n_tokens == len(x.ids)
        assert x.h == hashlib.sha256(",".join(map(str, x.ids)).encode()).hexdigest()


def test_toxicity(spark):
    r = random.Random(2)
    bad = ["snarkel", "grumbol", "vexling"]
    texts = []
    for i in range(300):
        w = prose(i, 40).split()
        if i % 3 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        texts.append(" ".join(w))
    df = frame(spark, texts + ODD)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(7, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, labels.where(~toxicity.held_out()))
    out = {x.doc_id: x for x in toxicity.toxicity(df, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((out[i].score >= 0.5) == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    a, e = map(int, out[0].spans.split(",")[0].split(":"))
    assert texts[0][a:e] in bad
    assert all(0 <= x.score <= 1 for x in out.values()) and out[300].score == out[301].score < 0.5
    again = df.union(frame(spark, [prose(900 + i, 40) for i in range(30)]))  # ids 0 to 29 stand for two texts each
    kept = toxicity.without_toxic(again.withColumn("row_hash", F.lit(3)), labels).collect()
    assert {x.text for x in kept} >= {prose(900 + i, 40) for i in range(30)} and not {x.text for x in kept} & {texts[i] for i in held if i % 3 == 0}
    assert toxicity.toxicity(df.limit(0), model).count() == 0 and len(toxicity.toxicity(df.select(F.lit(None).cast("long").alias("doc_id"), "text"), model).collect()) == df.count()
    nobody = toxicity.train(df, labels.limit(0))
    assert max(x.score for x in toxicity.toxicity(df, nobody).collect()) < 0.01


def test_field_marginals_equal_a_plain_pass():
    m = toxicity.Field(np.zeros(0, np.uint64))
    m.bias, m.step = -1.5, np.array([[0.3, -0.7], [-0.2, 0.9]])
    n, place, score = 23, np.array([0, 5, 6, 22]), np.array([2.0, 3.0, -1.0, 1.5])
    emit = np.ones((n, 2))
    emit[:, 1] = np.exp(m.bias)
    emit[place, 1] = np.exp(m.bias + score)
    a, b = [emit[0]], [np.ones(2)]
    for t in range(1, n):
        a.append((a[-1] @ np.exp(m.step)) * emit[t])
    for t in range(n - 1, 0, -1):
        b.append(np.exp(m.step) @ (emit[t] * b[-1]))
    p = np.array(a) * np.array(b[::-1])
    assert np.allclose(m.marginals(place, score, n, m.messages()), (p[:, 1] / p.sum(1))[place])


def test_html():
    page = """<html><head><title>x</title><script>var a="<p>no</p>"</script></head><body><header>Site</header><div class="main-menu">Home</div><article><h1>Head &amp;
 line</h1><p>One <b>bold</b> text<br>next&nbsp;part</p><div class="adBox">buy</div><p>Two</p><section id="comments"><p>reader says</p></section></article><form>f</form><footer>foot</footer>"""
    assert html_text.main_text(page) == "Head & line\nOne bold text\nnext part\nTwo"
    assert html_text.main_text(None) == "" == html_text.main_text("") and html_text.main_text("<p>only") == "only"
    plain = "<body><ul><li><a href=a>a</a></li><li><a href=b>b</a></li></ul><div><p>" + prose(1, 60) + "</p><p>" + prose(2, 50) + "</p></div></body>"
    assert html_text.main_text(plain).endswith(prose(1, 60) + "\n" + prose(2, 50))


def test_html_implied_ends_of_what_is_left_out():
    for body, want in [
        ("<div><p class=ad>buy<p>one<p>two</div>", "one\ntwo"),
        ("<p class=ad>buy <span>now<div>one</div>", "one"),
        ("<ul><li class=share>tell<li>one<li>two</ul>", "one\ntwo"),
        ("<ul><li>one<ul><li class=share>tell</ul><li>two</ul>", "one\ntwo"),
        ("<dl><dt class=ad>buy<dd>one<dt class=ad>buy<dt>two<dd class=ad>buy</dl>three", "one\ntwo\nthree"),
        ("<table><tr class=ad><td>buy<td>now<tr><td>one<td class=share>tell<td>two<tr><td>three</table>", "one\ntwo\nthree"),
        ("<table><tr><td class=ad><table><tr><td>inner<tr><td>inner</table><p>buy<td>one</table>", "one"),
        ("<p>one<noscript><div>no</div>no</noscript> two</p>", "one\ntwo"),
        ("<p>one<select><option>no<option>no</select> two<p>three", "one\ntwo\nthree"),
        ("<div class=ad><p>buy<p>buy<ul><li>buy<li>buy</ul>buy</div><p>one", "one"),
    ]:
        assert html_text.main_text(f"<article>{body}</article>") == want, body


def test_html_clusters_of_pages_without_marks():
    short = [prose(300 + i, 10) for i in range(9)]
    para = lambda ts: "".join(f"<p>{t}</p>" for t in ts)
    long = [prose(310 + i, 500) for i in range(3)]
    links = "<ul>" + "".join(f"<li><a href=x>{w}</a></li>" for w in WORDS[:12]) + "</ul>"
    two = "<div><ul><li><a href=x>one</a></li><li><a href=x>two</a></li></ul></div>"
    for name, body, want in [
        ("tail", f"{links}<div>{para([long[0], *short])}</div>{links}", [long[0], *short]),
        ("tail in the body", para([long[0], *short]) + links, [long[0], *short]),
        ("gap", f"{links}<div>{para([long[0], *short[:4], long[1]])}</div>", [long[0], *short[:4], long[1]]),
        ("headings", f"{links}<div><h1>Head</h1><p>By us</p>{para(long[:1])}<h2>Next</h2>{para(short[:3])}<h2>Last</h2>{para(short[3:5])}</div>{two}", ["Head", "By us", long[0], "Next", *short[:3], "Last", *short[3:5]]),
        ("list", f"{links}<div>{para(long[:1])}<ul>{''.join(f'<li>{t}</li>' for t in short[:5])}</ul>{para(short[5:])}</div>{links}", [long[0], *short]),
        ("table", f"{links}<div>{para(long[:1])}<table><tr><td>a<td>b<tr><td>c<td>d</table>{para(short[5:])}</div>{links}", [long[0], *"abcd", *short[5:]]),
        ("a container for each", f"{links}<div>{''.join(f'<div><p>{t}</p></div>' for t in [short[0], long[0], *short[1:5], long[1], *short[5:]])}</div>{links}", [short[0], long[0], *short[1:5], long[1], *short[5:]]),
        ("sections", f"{links}<div><h1>Head</h1><div>{para([long[0], short[0]])}</div>{two}<div>{para([short[1], long[1], short[2]])}</div></div>{links}", ["Head", long[0], short[0], short[1], long[1], short[2]]),
    ]:
        assert html_text.main_text(f"<html><body>{body}</body></html>") == "\n".join(want), name


def test_html_marks_do_not_choose_alone():
    long, short = [prose(320 + i, 200) for i in range(4)], [prose(330 + i, 10) for i in range(4)]
    para = lambda ts: "".join(f"<p>{t}</p>" for t in ts)
    card = lambda t: f"<article><h3><a href=x>More</a></h3><a href=x><img src=x></a><p>{t}</p><a href=x>read on</a></article>"
    cards, over = "".join(card(t) for t in ("ka lo", "mi nu", "re sa")), "<article><p>" + prose(340, 150) + "</p></article>"
    text = [long[0], short[0], long[1], short[1]]
    for name, body, want in [
        ("text beside cards", f"<div>{para(text)}</div>{cards}", text),
        ("text beside cards, one over the threshold", f"<div>{para(text)}</div>{cards}{over}", [*text, prose(340, 150)]),
        ("an article among cards", f"{cards}<article><h1>Head</h1>{para([*text, *short[2:]])}</article>{cards}", ["Head", *text, *short[2:]]),
        ("an article in main", f"<main><h1>Head</h1><article>{para([*text, *short[2:]])}</article><p>{short[0]}</p>{cards}</main>", ["Head", *text, *short[2:], short[0]]),
        ("text in main beside cards", f"<main>{cards}<div>{para(text)}</div>{cards}</main>", text),
        ("short articles", "".join(f"<article><p>{t}</p></article>" for t in short), short),
        ("nothing but a short article", f"<div><a href=x>Home</a></div><article><h1>Head</h1><p>{short[0]}</p></article>", ["Head", short[0]]),
    ]:
        assert html_text.main_text(f"<html><body>{body}</body></html>") == "\n".join(want), name


def test_token_cache(spark, tmp_path, monkeypatch):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in ODD if t is None or len(t) < 1000] + [prose(1, 30), " lead  and trail ", "<s>▁x▁▁", "a\nb c d"]
    cache = f"file://{tmp_path}/cache"
    got = {x.doc_id: x for x in token_cache.cached_token_counts(frame(spark, texts), path, cache, limit=20).collect()}
    for i, t in enumerate(texts):
        n = len(lib.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 20)
    stored = spark.read.parquet(cache).count()
    assert stored == len({t or "" for t in texts})
    monkeypatch.setattr(token_cache, "BUCKETS", 2)  # digests without copies share buckets with those that have them
    copies = spark.createDataFrame([(None, "same")] * 30 + [(3, "same"), (3, "other"), (None, None)], "doc_id long, text string")
    some = token_cache.cached_token_counts(copies, path, f"{cache}2").collect()
    assert len(some) == 33 and spark.read.parquet(f"{cache}2").count() == 3 and {x.n_tokens for x in some if x.n_bytes == 4} == {len(lib.encode("same"))}
    assert token_cache.cached_token_counts(copies.limit(0), path, f"{cache}3").count() == 0
    again = token_cache.cached_token_counts(frame(spark, [*texts, "new"]), path, cache).collect()
    assert len(again) == len(texts) + 1 and spark.read.parquet(cache).count() == stored + 1


def test_warc(spark, tmp_path, monkeypatch):
    rows = [(5, "http://www.a.com/x?q=1", "<p>é</p>"), (3, "http://b.org/", "<p>é</p>"), (9, None, None), (4, "not a url\n", ""), (7, "https://a.com/x#f", "other"), (7, "https://a.com/x", "other")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(df, folder)
    got = sorted((x.page_id, x.payload_bytes, x.record_type, x.refers_to) for x in warc.read_archives(df, folder).collect())
    assert got == [(3, 9, "response", None), (4, 0, "response", None), (5, 9, "revisit", 3), (7, 5, "response", None), (7, 5, "response", None), (9, 0, "revisit", 4)]
    index = warc.CaptureIndex(folder)
    assert [h["WARC-Page-ID"] for h, _ in index.lookup("http://b.org/")] == ["3"] and len(index.lookup("https://a.com/x")) == 2 and index.lookup("http://none.io/") == []
    assert warc.url_key("http://www.a.com/x?q=1") == "com,a)/x?q=1"
    warc.write_archives(df.limit(0), f"file://{tmp_path}/e")
    assert warc.read_archives(df, f"file://{tmp_path}/e").count() == 0
    # small blocks and parts; many captures of one key; null ids, urls and payloads; repeated rows
    monkeypatch.setattr(warc, "BLOCK_ROWS", 3)
    monkeypatch.setattr(warc, "DIRECTORY_ROWS", 2)
    monkeypatch.setattr(shared, "HOT_SHARE", 3)
    r = random.Random(4)
    rows = [(r.choice((None, *range(40))), r.choice((None, "http://a.com/", f"http://b{r.randrange(9)}.org/\t{r.randrange(3)}")), r.choice((None, "", "same", f"p{r.randrange(12)}"))) for _ in range(150)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/m"
    warc.write_archives(df.withColumn("first_id", F.lit(1)).withColumn("d", F.lit(2)), folder)
    got = [(x.page_id, x.payload_bytes, x.payload_digest, x.record_type, x.refers_to) for x in warc.read_archives(df, folder).collect()]
    least = {}
    for i, _, h in rows:
        least[h or ""] = min((x for x in (i, least.get(h or "")) if x is not None), default=None)
    again = lambda i, h: least[h or ""] if least[h or ""] is not None and i != least[h or ""] else None
    want = [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if again(i, h) is None else "revisit", again(i, h)) for i, _, h in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_decontamination(spark, monkeypatch):
    items = [prose(100 + i, 25) for i in range(5)] + ["too short", None, "", "ONE", *ODD[-1:]]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    swapped = items[1].split()
    for i in (2, 7, 12, 17, 22):
        swapped[i] = "other"
    texts = [prose(1, 80), prose(2, 40) + " " + items[0].upper() + ", " + prose(3, 40), "start " + " ".join(swapped), prose(4, 30) + " " + " ".join(items[2].split()[:5]) + " " + prose(5, 30), " ".join(items[3].split()[:18]), *ODD, "it is Too, short! here", "too many short"]
    odd = {(i, 8) for i, t in enumerate(texts) if t == "one"} | {(12, 9), (13, 5)}
    want = {(1, 0), (2, 1), (4, 3)} | odd
    got = decontaminate.contamination(frame(spark, texts), bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    one = next(x for x in got if x.doc_id == 1)
    assert texts[1][one.first_char : one.end_char] == items[0].upper() and one.n_same == 25
    monkeypatch.setattr(decontaminate, "FEW_SEEDS", 0)
    monkeypatch.setattr(decontaminate, "SALT_WORDS", 10)
    shuffled = decontaminate.contamination(frame(spark, texts), bench).collect()
    assert sorted(map(tuple, shuffled)) == sorted(map(tuple, got))
    assert sorted(x.doc_id for x in decontaminate.without_contaminated(frame(spark, texts), bench).collect()) == [i for i in range(len(texts)) if i not in {d for d, _ in want}]
    # a namesake of a contaminated row stays, a repeated row gets its own result, a null id too
    rows = [(1, items[0]), (1, texts[0]), (2, items[0]), (2, items[0]), (None, items[1]), (None, texts[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "1 AS row_id", "2 AS row_hash", "3 AS item")
    assert sorted((x.doc_id or 0, x.item_id) for x in decontaminate.contamination(df, bench).collect()) == [(0, 1), (1, 0), (2, 0), (2, 0)]
    kept = decontaminate.without_contaminated(df, bench)
    assert kept.columns == df.columns and sorted((x.doc_id or 0, x.text) for x in kept.collect()) == sorted([(1, texts[0]), (0, texts[0])])
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
    assert decontaminate.contamination(frame(spark, texts), bench.limit(0)).count() == 0


def brute_contamination(texts, items, share=0.6, window=16, window_hits=13):
    """{(document, item): most agreeing words} over every diagonal."""
    words = lambda t: re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    out = {}
    for i, k in itertools.product(range(len(texts)), range(len(items))):
        d, w = words(texts[i]), words(items[k])
        for shift in range(1 - len(w), len(d)):
            same = [d[shift + j] == w[j] for j in range(max(0, -shift), min(len(w), len(d) - shift))]
            if (sum(same) == len(w) if len(w) < 8 else sum(same) >= share * len(w)) or len(w) >= 8 and any(sum(same[j : j + window]) >= window_hits for j in range(len(same))):
                out[i, k] = max(out.get((i, k), 0), sum(same))
    return out


def test_decontamination_equals_brute_force_on_all_diagonals(spark):
    sizes = [1, 2, 3, 5, 7, 8, 9, 10, 11, 13, 15, 16, 17, 19, 20, 22, 25, 30, 36, 44, 59]
    items = [prose(200 + n, n) for n in sizes]
    r, texts, sure = random.Random(5), [], set()
    for k, item in enumerate(items):
        w = item.split()
        least = -(-6 * len(w) // 10)
        kept = [{j for j in range(len(w)) if "11010"[(j + s) % 5] == "1"} for s in range(5)] + [{j for j in range(len(w)) if j % 3 != s} for s in range(3)]
        kept += [set(r.sample(range(len(w)), least + e)) for e in (0, 0, 0, 0, 0, 0, -1)]
        for at in kept:
            inner = " ".join(x if j in at else "other" for j, x in enumerate(w))
            texts.append(r.choice(("", prose(len(texts), 9) + " ")) + inner + r.choice(("", " " + prose(len(texts) + 1, 7))))
            if len(at) >= 0.6 * len(w) and (len(w) >= 8 or len(at) == len(w)):
                sure.add((len(texts) - 1, k))
        for n in (12, 13, 15):  # a document that begins or ends within the item
            texts += [prose(len(texts), 20) + " " + " ".join(w[:n]), " ".join(w[-n:]) + " " + prose(len(texts), 20)]
            if 13 <= n <= len(w):
                sure |= {(len(texts) - 2, k), (len(texts) - 1, k)}
    want = brute_contamination(texts, items)
    assert sure <= set(want)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = decontaminate.contamination(frame(spark, texts), bench).collect()
    assert {(x.doc_id, x.item_id): x.n_same for x in got} == want
    loose = decontaminate.contamination(frame(spark, texts[::4]), bench, share=0.35, window=9, window_hits=6).collect()
    assert {(x.doc_id, x.item_id): x.n_same for x in loose} == brute_contamination(texts[::4], items, 0.35, 9, 6)


def test_licenses(spark):
    mit = licenses.NOTICES["mit"][0].split()
    texts = ["Released UNDER the MIT-License. under the mit license", " ".join(mit[:20] + ["oddly"] + mit[20:]), "Apache License, Version 2 cc by-nc", "Licensed by K nobody", "GNU", *ODD]
    got = {x.doc_id: x for x in licenses.license_scan(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (2, 1, 5, "mit")
    assert got[1].base_labels == "" and got[1].labels == "mit" and 0.9 < got[1].score <= 1
    assert got[2].base_labels == "apache-2,cc-by-nc" and got[2].n_words == 7
    assert (got[5].n_words, got[5].n_base, got[5].first_word, got[5].labels, got[5].score) == (0, 0, None, "", 0.0)
    plan = licenses.license_scan(frame(spark, texts))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_quality(spark):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        hit = {i + j for i, g in enumerate(win) if win.count(g) > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit)

    texts = [prose(i, 60).capitalize() + "." for i in range(40)] + [" ".join(x + "***" for x in prose(50 + i, 50).split()) for i in range(6)] + [(prose(3, 8) + "\n") * 6, "a b c d e a b c d e", *ODD]
    got = {x.doc_id: x for x in quality.quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == brute(t), t
        assert x.base_failed == (x.n_words < 10 or 100 * x.n_repeat_words > 20 * x.n_words) and not (x.kept and x.base_failed)
    assert all(got[i].kept for i in range(40)) and not any(got[i].kept for i in range(40, 46))
    assert quality.quality(frame(spark, texts).limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = corpus_pipeline.run(spark, SF).collect()
    by = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id: r for r in out}
    assert len(kept) == len(out) and 0.5 * len(by) < len(out) < len(by)
    texts = [kept[i].text for i in sorted(kept)]
    roots = [c for _, c in brute_components([by[i].text for i in sorted(kept)], 80, 100, 5)]
    assert len(set(roots)) == len(roots)
    items = [" ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", r.text.lower())) for r in bench.collect()]
    for t in texts:
        low = " ".join(re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower()))
        assert not any(i in low for i in items if len(i.split()) >= 8)
        assert not pii.base_spans(t)
    assert all(r.n_tokens == len(r.ids) for r in out)
