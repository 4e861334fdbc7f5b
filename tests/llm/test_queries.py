"""The opN_ queries themselves on small tables: columns, types and what the contract fixes, against brute force."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from lakepress.llm import html_text, licenses, queries
from lakepress.llm.queries import tokenizer_file

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = "kaba lodo mife nugu resa tiba kalo dofe the and".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


TEXTS = [None, "", " \n\t", "one", "Under the MIT license, cc by nc; APACHE License Version 2", "under the\u212a mit license", "K \u212a k \u00c9t\u00e9", "mail a.b@c.de from 10.0.0.1 or 4539 1488 0343 6467, +1 803 555 5351 \u4e2d 1.2.3.4", prose(1, 200), prose(1, 200), "x" * 300_000, (prose(2, 6) + "\n") * 5, prose(3, 30) + " " + prose(7, 20)]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "another text of three"), (None, prose(4, 40)), (None, None), (8, TEXTS[8])]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i == 7)) for i in range(13)] + [(99, 0, 1), (None, 0, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, "http://a.com/", "<article><p>Some &amp; text</p></article>"), (2, None, None), (3, "http://a.com/", ""), (None, "x", "<p>p</p>"), (1, "http://a.com/", "<article><p>Some &amp; text</p></article>"), (5, "y", "<nav>n</nav>")], "page_id long, url string, html string")
    bench = spark.createDataFrame([(0, prose(7, 20)), (1, None), (2, ""), (3, "another text of three")], "item_id long, text string")
    for name, df in (("documents", docs), ("labels", labels), ("pages", pages), ("benchmark", bench)):
        df.coalesce(1).write.parquet(f"{top}/full/{name}.parquet")
        df.limit(0).coalesce(1).write.parquet(f"{top}/empty/{name}.parquet")
    return str(top)


def words(pattern, t):
    return re.findall(pattern, (t or "").translate(LOW))


def base_spans(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)] if "@" in t else []
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in re.sub("[^0-9]", "", m[0])][::-1]
        if 16 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def op2(t):
    s = base_spans(t)
    return (*[sum(k == x[0] for x in s) for k in ("email", "ip", "card", "phone")], hashlib.sha256(",".join("%s:%d:%d" % x for x in s).encode()).hexdigest())


def op3(t):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    ids = lib.encode(t or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def op6(t):
    import sentencepiece

    n = len(sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model")).encode(t or ""))
    return len((t or "").encode()), n, n > 4096


def op9(t):
    w = words(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    places = [(i, label) for text, label in licenses.PHRASES.items() for p in [text.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def op10(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + j for i, g in enumerate(win) if win.count(g) > 1 for j in range(5)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def rows_of(df, *cols):
    return sorted((repr(tuple(r[c] for c in cols)) for r in df.collect()))


def want(brute):
    return sorted(repr((i, *brute(t))) for i, t in ROWS)


CASES = {
    "op2_pii": (op2, "doc_id n_email n_ip n_card n_phone base_sha256", "bigint " * 5 + "string"),
    "op3_bpe": (op3, "doc_id n_tokens ids_sha256 decoded_sha256", "bigint bigint string string"),
    "op6_token_counts": (op6, "doc_id n_bytes n_tokens over_limit", "bigint bigint bigint boolean"),
    "op9_licenses": (op9, "doc_id n_words n_base first_word last_word base_labels", "bigint " * 5 + "string"),
    "op10_quality": (op10, "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed", "bigint " * 6 + "boolean"),
}


@pytest.mark.parametrize("name", CASES)
def test_query_against_brute_force(spark, folders, name):
    brute, cols, types = CASES[name]
    df = queries.QUERIES[name](spark, f"{folders}/full")
    assert [dict(df.dtypes)[c] for c in cols.split()] == types.split()
    assert rows_of(df, *cols.split()) == want(brute)
    assert queries.QUERIES[name](spark, f"{folders}/empty").count() == 0


def test_op1_query(spark, folders):
    df = queries.QUERIES["op1_ngram_jaccard"](spark, f"{folders}/full")
    assert df.dtypes == [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint")]
    sets = []
    for i, t in ROWS:
        w = words(r"[^\x20\x09-\x0D]+", t)
        sets.append((i, frozenset(tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))) if w else frozenset()))
    link = lambda a, b: bool(a) and 100 * len(a & b) >= 85 * len(a | b)
    least = [min((j for j, b in sets if j is not None and link(a, b)), default=None) for i, a in sets]  # no chains in these texts
    assert rows_of(df, "doc_id", "n_shingles", "component_id") == sorted(repr((i, len(a), i if m is None else m)) for (i, a), m in zip(sets, least, strict=True))
    assert queries.QUERIES["op1_ngram_jaccard"](spark, f"{folders}/empty").count() == 0


def test_op4_query(spark, folders):
    df = queries.QUERIES["op4_toxicity"](spark, f"{folders}/full")
    assert df.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = df.collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    assert queries.QUERIES["op4_toxicity"](spark, f"{folders}/empty").count() == 0


def test_page_queries(spark, folders):
    df = queries.QUERIES["op5_html_text"](spark, f"{folders}/full")
    assert df.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert rows_of(df, "page_id", "text", "n_chars") == sorted(map(repr, [(1, "Some & text", 11), (1, "Some & text", 11), (2, "", 0), (3, "", 0), (None, "p", 1), (5, "", 0)]))
    df = queries.QUERIES["op7_warc"](spark, f"{folders}/full")
    assert df.dtypes == [("page_id", "bigint"), ("payload_bytes", "bigint"), ("payload_digest", "string"), ("record_type", "string"), ("refers_to", "bigint")]
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    one, p = "<article><p>Some &amp; text</p></article>", "<p>p</p>"
    assert rows_of(df, *df.columns) == sorted(map(repr, [(1, len(one), sha(one), "response", None)] * 2 + [(2, 0, sha(""), "response", None), (3, 0, sha(""), "revisit", 2), (None, 8, sha(p), "response", None), (5, 12, sha("<nav>n</nav>"), "response", None)]))
    for name in ("op5_html_text", "op7_warc"):
        assert queries.QUERIES[name](spark, f"{folders}/empty").count() == 0


def test_op8_query(spark, folders):
    df = queries.QUERIES["op8_decontaminate"](spark, f"{folders}/full")
    assert df.columns == ["doc_id", "item_id", "n_same", "n_item", "first_char", "end_char"]
    assert sorted((r.doc_id, r.item_id, r.n_same) for r in df.collect()) == [(3, 3, 4), (12, 0, 20)]
    assert queries.QUERIES["op8_decontaminate"](spark, f"{folders}/empty").count() == 0


def test_pipeline_on_odd_and_empty_tables(spark, folders):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, f"{folders}/full")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"]
    texts = [r.text for r in out.collect()]
    assert "another text of three" not in texts and "one" in texts and texts.count(prose(1, 200)) == 1
    assert not any(base_spans(t) for t in texts)
    assert corpus_pipeline.run(spark, f"{folders}/empty").count() == 0


def test_licence_spans(spark):
    whole = licenses.TEXTS["mit"]
    torn = " ".join(w for k, w in enumerate(whole.split()) if k % 25)
    texts = ["of this software " * 40, "THIS WORK IS LICENSED UNDER A CREATIVE COMMONS ATTRIBUTION 4.0 INTERNATIONAL LICENSE", prose(5, 50) + " " + torn, licenses.TEXTS["bsd"].upper() + prose(6, 9) + licenses.TEXTS["isc"], None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "text", "1 AS row", "2 AS h", "3 AS near")
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert [got[k].labels for k in range(5)] == ["", "cc-by", "mit", "bsd,isc", ""]
    assert got[1].score == 1.0 and 0.6 <= got[2].score < 1 and got[2].spans.startswith("mit:50:")


def test_names_only_make_suspects():
    para = "<p>" + prose(9, 40) + "</p>"
    text = "\n".join([prose(9, 40)] * 3)
    for name in ("content no-sidebar", "has-header", "page-with-menu", "legal"):
        for head in ("", "<h1>Head</h1>"):
            page = f'<html><body><nav><a href=x>Home</a></nav><div class="{name}">{head}{para * 3}</div><div class="site-footer">{prose(8, 60)}</div></body></html>'
            assert html_text.main_text(page) == ("Head\n" if head else "") + text, name
    page = f'<article>{para}<p class="lead share">{prose(7, 30)}</p><div class="cookie-banner">{prose(6, 90)}</div><div id="comments"><article>{para}</article></div></article>'
    assert html_text.main_text(page) == prose(9, 40) + "\n" + prose(7, 30)
    assert html_text.main_text(f'<div class="share-of-market"><h1>T</h1>{para}</div>') == "T\n" + prose(9, 40)


@pytest.mark.parametrize("page", ["<b>" * 100_000 + "</i>" * 100_000, "<div>" * 100_000 + "x", "<table><p>" + "<b>" * 30_000 + "<div>x" * 30_000, "<!--" * 60_000, "<a " * 60_000, '<div class="ad x">y' * 30_000, "<ul><li>x" * 30_000])
def test_broken_pages_take_linear_time(page):
    html_text.main_text(page[:1000])
    start = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - start < 15


def test_smoothing_and_choice_by_hand():
    r = np.random.default_rng(3)
    x = r.random(40) * 100
    for sigma in (0.7, 1.0, 2.0):
        reach = max(1, int(3 * sigma))
        plain = []
        for i in range(len(x)):
            w = [(np.exp(-0.5 * ((j - i) / sigma) ** 2), x[j]) for j in range(max(0, i - reach), min(len(x), i + reach + 1))]
            plain.append(sum(a * b for a, b in w) / sum(a for a, _ in w))
        assert np.allclose(html_text.smooth(x, sigma), plain)
    # on a page without marks the lines of high smoothed ratio stay, by a plain loop; lists of links around them go
    lengths, links = [400, 380, 420], "".join(f"<ul><li><a href=x>{'b' * 4}</a></li></ul>" for _ in range(5))
    body = links + "".join(f"<div><p>{'a' * n}</p></div>" for n in lengths) + links
    assert [len(t) for t in html_text.main_text(f"<html><body>{body}</body></html>").split("\n")] == lengths
