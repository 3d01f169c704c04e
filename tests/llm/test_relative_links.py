"""Link targets in every form reach the address they name."""

from tidemark.llm import urls

PAGE = "http://A.com/x/y/p.html?q=1"
CANONICAL = {
    "https://b.com/1": "b.com/1", "//b.com/2": "b.com/2", "/new": "a.com/new", "page.html": "a.com/x/y/page.html", "./k": "a.com/x/y/k", "../k?z=1#f": "a.com/x/k?z=1",
    "../../../k/": "a.com/k/", "..": "a.com/x/", "?r=2": "a.com/x/y/p.html?r=2", "/r?to=http://c.com/": "a.com/r?to=http://c.com/",
    "/a?b&#61;1&amp;c&#x3d;2&eacute;": "a.com/a?b=1&c=2é", "/&amp;lt;": "a.com/&lt;", "#top": None, "mailto:me@b.com": None, "/x/y/p.html?q=1": None,
}
REFRESH = {
    '"0; url=/n"': "a.com/n", '"0;/n"': "a.com/n", '"5; n.html"': "a.com/x/y/n.html", "'3, URL = //b.com/n'": "b.com/n", "0;url=http://b.com/u": "b.com/u",
    '"0; http://b.com/?url=/k"': "b.com/?url=/k", "\"0; url='/n'\"": "a.com/n", '"30"': None,
}


def test_every_form_of_target(spark):
    forms = [(f"<link rel=canonical href='{t}'>", w) for t, w in CANONICAL.items()] + [(f"<meta http-equiv=refresh content={t}>", w) for t, w in REFRESH.items()]
    for html, want in forms:
        forms_page = spark.createDataFrame([(PAGE, html)], "url string, html string")
        assert [r["dst"] for r in urls.link_edges(forms_page).collect()] == ([want] if want else []), html


def test_blocks_reach_relative_aliases(spark):
    rows = [(0, "http://a.com/x/", "<meta http-equiv=refresh content='0; ../go'>"), (1, "http://a.com/go", "<link rel=canonical href='//bad.net/'>"), (2, "http://b.com", "<link rel=canonical href=k>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert [r["verdict"] for r in urls.judge_urls(pages).orderBy("page_id").collect()] == ["block", "block", "allow"]


MARKUP = {
    "<link rel='alternate canonical' href=/a>": ["a.com/a"], "<link href=/a rel=canonical><link rel=canonical href=/b>": ["a.com/a", "a.com/b"],
    "<!-- <link rel=canonical href=/a> -->": [], "<script>'<link rel=canonical href=/a>'</script><LINK REL=Canonical HREF=' /b '>": ["a.com/b"], "<!-- <link rel=canonical href=/a>": [],
    "<base href='//c.com/d/'><link rel=canonical href=e>": ["c.com/d/e"], "<link rel=canonical data-href=/a>": [], "<link rel=noncanonical href=/a>": [], "<link rel=canonical>": [],
    "<style><link rel=canonical href=/a></style><meta name=refresh content='0;/k'>": [], "<meta content='0;/k' http-equiv=Refresh><link rel=canonical href=/a>": ["a.com/a", "a.com/k"],
}


def test_tags_that_a_browser_reads(spark):
    pages = spark.createDataFrame([(f"http://a.com/{k}", html) for k, html in enumerate(MARKUP)], "url string, html string")
    found = [(r["src"], r["dst"]) for r in urls.link_edges(pages).collect()]
    assert sorted(found) == sorted((f"a.com/{k}", dst) for k, want in enumerate(MARKUP.values()) for dst in want)


def test_long_broken_pages(spark):
    html = "canonical" + "<!--" * 200_000 + "<script>" * 100_000 + "<link " * 100_000 + "x" * 1_000_000
    pages = spark.createDataFrame([("http://a.com/", html), ("http://b.com/", html.replace("<!--", "<link rel=canonical href=/" + "y" * 9 + ">", 1).replace("<!--", ""))], "url string, html string")
    assert [r["src"] for r in urls.link_edges(pages).collect()] == ["b.com/"]
