import hashlib
import random
import tarfile
import zlib

import pytest
from pyspark.sql import functions as F

from tests.helpers import duck, same_rows
from tidemark.llm import html_text, lines, media, mixing, queries, urls

SF = "/root/testdata/sf0.001"


# --- media ---

def test_png_round_trip():
    for text in (b"", b"a", b"x" * 576, random.Random(1).randbytes(5000)):
        payload = media.payload_of(text)
        assert len(payload) % 576 == 0 and payload and payload.startswith(text) and set(payload[len(text) :]) <= {255}
        stored = media.to_png(payload)
        assert media.from_png(stored) == payload and media.png_header(stored[: media.HEADER_BYTES])[1] == len(payload) // 576


def test_media_rows(docs, tmp_path):
    texts = ["hello", "hello", None, "", "é" * 1000, "z" * 300_000]
    folder = f"file://{tmp_path}/store"
    rows = {r["doc_id"]: r for r in media.media_columns(docs(texts).repartition(3), folder).collect()}
    assert len(rows) == len(texts)
    for k, t in enumerate(texts):
        text = (t or "").encode()
        payload = text + b"\xff" * (-len(text) % 576) or b"\xff" * 576
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(text), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert (r["width"], r["height"], r["bit_depth"], r["color_type"]) == (576, len(payload) // 576, 8, 0)
        with open(r["shard"].removeprefix("file://"), "rb") as shard:
            shard.seek(r["offset"])
            assert hashlib.sha256(shard.read(r["length"])).digest() == r["media_sha256"]
    same = [tuple(v for c, v in rows[k].asDict().items() if c != "doc_id") for k in (0, 1, 2, 3)]
    assert same[0] == same[1] and same[2] == same[3]
    names = set()
    for shard in (tmp_path / "store/shards").iterdir():
        with tarfile.open(shard) as tar:
            names |= {m.name for m in tar}
    assert names == {f"{r['media_sha256'].hex()}.png" for r in rows.values()}


# --- lines ---

def plain_dedup(rows, min_sites):
    spread, first = {}, {}
    for i, text, site in rows:
        for line in (text or "").split("\n"):
            if key := line.strip(lines.SPACES):
                spread.setdefault(key, set()).add(site)
                if i is not None:
                    first[key] = min(first.get(key, i), i)
    out = []
    for i, text, _ in rows:
        kept = [x for x in (text or "").split("\n") if len(spread.get(x.strip(lines.SPACES), ())) < min_sites or i is not None and first[x.strip(lines.SPACES)] == i]
        out.append((i, "\n".join(kept) if text is not None else None, len((text or "").split("\n")) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("min_sites", [2, 5, 8])
def test_lines_equal_brute_force(spark, docs, min_sites):
    random.seed(min_sites)
    pool = [f"line {k} of text" for k in range(12)] + ["", "  ", "\tline 3 of text "]
    texts = ["\n".join(random.choice(pool) for _ in range(random.randint(0, 6))) for _ in range(80)] + [None, "", "a\u2028b"]
    sources = [random.choice([None, *"abcdefghij"]) for _ in texts]
    table = docs(texts, sources).withColumn("n_lines", F.lit("clash"))
    got = sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_lines(table, min_sites).collect()), key=str)
    assert got == plain_dedup(list(zip(range(len(texts)), texts, sources)), min_sites)


def test_lines_with_repeated_and_null_ids(docs):
    table = docs(["x y\nz"] * 4, [*"abcd"], ids=[3, 3, None, 9])
    rows = sorted(((r["doc_id"] or -1, r["text"]) for r in lines.dedup_lines(table, 3).collect()))
    assert rows == [(-1, ""), (3, "x y\nz"), (3, "x y\nz"), (9, "")]
    gone = lines.dedup_lines(table, 3, keep_first=False)
    assert {r["text"] for r in gone.collect()} == {""}


@pytest.mark.parametrize("name", ["op2_mixing", "op8_line_dedup", "op9_url_filter", "url_redirects"])
def test_queries_equal_oracles(spark, name):
    same_rows(queries.QUERIES[name](spark, SF), queries.ORACLES[name], duck(SF))


@pytest.mark.parametrize("name", ["op8_line_dedup", "op9_url_filter", "url_redirects"])
def test_native_plans_have_no_python(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# --- mixing ---

def test_mixing_meets_weights(docs):
    texts = ["word " * 10] * 4000
    sources = ["big"] * 3000 + ["small"] * 900 + [None] * 100
    mixed = mixing.mix(docs(texts, sources), {"big": 1.0, "small": 2.0}, exponent=0.0).groupBy("source").count().collect()
    got = {r["source"]: r["count"] for r in mixed}
    for name, weight in (("big", 1), ("small", 2), (None, 1)):
        assert abs(got[name] / 4000 - weight / 4) < 0.05
    assert got[None] > 800, "a rate over PART_MEAN"


def test_mixing_is_repeatable_and_keeps_columns(docs):
    table = docs(["a", None, "", "b"] * 20, ["s", "t"] * 40).withColumn("replica", F.lit("clash"))
    runs = [sorted(map(str, mixing.mix(t).collect())) for t in (table, table.repartition(5))]
    assert runs[0] == runs[1] and runs[0]
    assert mixing.mix(table).columns == ["doc_id", "text", "lang", "source", "n_chars", "replica", "order_key"]
    keys = [r["order_key"] for r in mixing.mix(docs(["x"] * 500)).collect()]
    assert len(set(keys)) == len(keys)


# --- urls ---

def judged(spark, rows, redirects=None):
    pages = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    if redirects is not None:
        redirects = spark.createDataFrame(redirects, "from_url string, to_url string")
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(pages, redirects=redirects).orderBy("page_id").collect()]


def test_rules_and_odd_urls(spark):
    found = judged(spark, [
        ("http://A.Example.NET/en/x?q#f", ""), ("http://example.net/fr/", None), ("http://net", ""), ("http://notexample.com/de/", ""),
        ("https://x.example.com/de/1#a", ""), ("http://example.org/fr/?x", ""), (None, ""), ("no scheme/de/", ""), ("x://y.org#/fr/", ""), ("http://example.com/DE/", ""),
    ])
    assert found == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/fr/", "net/", "block"), ("net", "", None, "allow"), ("notexample.com", "/de/", None, "allow"),
        ("x.example.com", "/de/1", "example.com/de/", "block"), ("example.org", "/fr/", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("y.org", "", None, "allow"), ("example.com", "/DE/", None, "allow"),
    ]


def test_blocks_reach_aliases_and_allows_win(spark):
    canonical = lambda u: f'<head><LINK href="{u}" rel=canonical></head>'
    rows = [
        ("http://a.com/1", canonical("https://b.com/2")), ("http://b.com/2#x", '<meta http-equiv="refresh" content="0; url=http://evil.net/p">'),
        ("http://c.com/", ""), ("http://d.com/", canonical("http://evil.net/q?a=1&amp;b=2")), ("http://example.net/en/k", canonical("http://evil.net/z")),
        ("http://e.com/", canonical("http://evil.net/z")), ("http://evil.net/z", ""),
    ]
    verdicts = [v for *_, v in judged(spark, rows, [("http://c.com/", "http://hop.com/"), ("http://hop.com/", "http://evil.net/y")])]
    assert verdicts == ["block", "block", "block", "block", "allow", "allow", "block"]


def test_long_redirect_chain_and_empty(spark):
    chain = [(f"http://h{k}.com/", f"http://h{k + 1}.com/") for k in range(30)] + [("http://h30.com/", "http://bad.net/")]
    assert [v for *_, v in judged(spark, [("http://h0.com/", None), ("http://h99.com/", None)], chain)] == ["block", "allow"]
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- html ---

PAGE = """<html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body><header><h1>Site</h1></header>
<div class="menu"><ul><li><a href=x>One</a><li><a href=y>Two</a></ul></div>%s<div class="sidebar"><p>Side stuff</p></div>
<div id="comments"><p>nice post! I really like all of this long comment text that goes on.</p></div><footer>bye &copy;</footer></body></html>"""
BODY = """<div class="cookie-notice">We use cookies</div><h2>Real &amp; title</h2><p>First   paragraph of\nthe real article and more text here.</p>
<p>Short.</p><div class="ad">Buy</div><p><b>Third<br>paragraph</b> with a <a href=q>link</a> inside it and yet more words, many of them.
<p>Fourth &lt;one&gt;</p><form><input name=q><button>Go</button></form><ul><li>item one<li>item two</ul>"""
WANT = "Real & title|First paragraph of the real article and more text here.|Short.|Third paragraph with a link inside it and yet more words, many of them.|Fourth <one>|item one|item two"


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main><article class='post'>%s</article></main>", "<div class='content'>%s</div>", "<section>%s</section>"])
def test_article_text(wrap):
    assert html_text.main_text(PAGE % (wrap % BODY)).split("\n\n") == WANT.split("|")


def test_names_of_parts():
    page = """<body><div class="wrap has-sidebar no-header"><p>Main words stand here, and there are enough of them to count as text.</p>
    <pre>x = 1 <span class="comment"># kept</span> <span class="ad">gone</span> and <script>track()</script>on</pre><div id="cookieBanner">Cookies</div><div class="post-comments"><p>me too</p></div></div></body>"""
    assert html_text.main_text(page).split("\n\n") == ["Main words stand here, and there are enough of them to count as text.", "x = 1 # kept and on"]


@pytest.mark.parametrize("page", [
    "<html><head><title>t</title><body><p>Some words of text.</p>", "<nav><a>x</a><article><p>Some words of text.</p></article>",
    "<form action=x><div><p>Some words of text.</p></div></form>", "<form><header><h1>t</h1></header><main><p>Some words<!-- c --> of\u00a0text.</p></main></form>",
])
def test_broken_or_wrapped_pages(page):
    assert html_text.main_text(page) == "Some words of text."


def test_html_rows(spark):
    rows = [(0, "u", PAGE % f"<article>{BODY}</article>"), (1, None, None), (2, "u", ""), (3, "u", "<p>unclosed <b>text &am"), (4, "u", "<nav><a>x</a></nav>"), (5, "u", "plain &eacute;")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    assert found[0]["text"] == WANT.replace("|", "\n\n") and all(r["n_chars"] == len(r["text"]) for r in found.values())
    assert [found[k]["text"] for k in (1, 2, 3, 4, 5)] == ["", "", "unclosed text &am", "", "plain é"]
    assert html_text.extract_text(pages.where("false")).count() == 0


def test_smoothing_is_gaussian_and_clusters_by_threshold():
    import numpy as np

    flat = html_text.smoothed(np.ones(7))
    assert np.allclose(flat, 1)
    values = html_text.smoothed(np.array([0.0] * 6 + [100.0] * 6))
    assert (html_text.content_lines(values) == ([False] * 6 + [True] * 6)).all()
