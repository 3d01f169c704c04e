"""URL filters with redirect equivalence, with DataFrame functions only."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut_lineage
from tidemark.llm.components import connected_components

#: (verdict, host, path): fits the host and its subdomains where the path starts with the rule's.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What a browser does not read tags in, up to the end of the page if it is never closed.
_UNREAD = r"(?is)<!--.*?(?:--!?>|\z)|<(script|style|textarea|template|noscript|title|xmp|iframe)\b[^<>]*>.*?(?:</\1\s*>|\z)"
_TAGS = r"(?i)<(?:link|meta|base)\b[^<>]*>"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/ ? #`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """What two spellings of an address share: host, path and query, without scheme and fragment."""
    return F.concat(host_of(url), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """The longest rule that fits, as ``struct<rule, verdict>``, or null. A null host or path fits none."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def unescaped(text: Column) -> Column:
    """Character references (decimal, hexadecimal, named; with their semicolon) replaced by their characters, once."""
    named = F.from_json(F.lit(json.dumps({f"&{k}": v for k, v in html5.items() if k.endswith(";")})), "map<string,string>")

    def char(ref: Column) -> Column:
        number = F.coalesce(F.conv(F.regexp_extract(ref, r"^&#[xX]0*([0-9a-fA-F]{1,6});$", 1), 16, 10), F.lit(""))
        number = F.when(ref.rlike("^&#[xX]"), number).otherwise(F.regexp_extract(ref, r"^&#0*([0-9]{1,7});$", 1)).try_cast("int")
        good = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        coded = F.decode(F.unhex(F.lpad(F.hex(F.when(good, number)), 8, "0")), "UTF-32")
        return F.coalesce(F.when(ref.startswith("&#"), coded).otherwise(F.element_at(named, ref)), ref)

    reference = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"
    parts, found = F.split(text, reference, -1), F.regexp_extract_all(text, F.lit(reference), F.lit(0))
    joined = F.array_join(F.zip_with(parts, found, lambda p, r: F.concat(p, F.when(r.isNull(), "").otherwise(char(r)))), "")
    return F.when(F.contains(text, F.lit("&")), joined).otherwise(text)


def resolved(target: Column, url: Column) -> Column:
    """The absolute address of a link target on the page ``url``; null for other schemes, fragments and nothing."""
    scheme, host = F.regexp_extract(url, r"(?s)^(.*?)://", 1), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(target, r"(?s)^([^?#]*)", 1)
    tail = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own = path_of(url)
    folder = F.regexp_replace(own, r"[^/]*$", "")
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    steps = F.aggregate(
        F.split(F.substring(whole, 2, 1 << 30), "/", -1), F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    ends = F.when(whole.rlike(r"/\.\.?$") & (F.size(steps) > 0), "/").otherwise("")
    clean = F.concat(F.lit("/"), F.array_join(steps, "/"), ends)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") | target.startswith("#") | (target == ""), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(path == "", F.concat(scheme, F.lit("://"), host, own, tail))
        .otherwise(F.concat(scheme, F.lit("://"), host, clean, tail))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, without its quotes and outer white space; empty if there is none."""
    value = F.regexp_extract(tag, rf"(?is)[\s\"'/]{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.regexp_replace(value, r"^[\"']?\s*|\s*[\"']?$", "")


def link_edges(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``src, dst`` (addresses as in node_of): canonical links and refresh redirects that pages declare.

    All tags of a page count that a browser would read (not those in comments, scripts and the like); ``rel`` may hold
    several words, a refresh may leave out ``url=``. Character references in a target are decoded; relative targets are resolved
    against the page's address, or against its first base element.
    """
    html = F.col(html_col).cast("string")
    told = F.contains(F.lower(html), F.lit("canonical")) | F.contains(F.lower(html), F.lit("refresh"))
    rows = pages.select(F.col(url_col).cast("string").alias("url"), html.alias("html"), told.alias("told")).where("told AND contains(url, '://')")
    rows = rows.select("url", _once(F.regexp_replace("html", _UNREAD, " ")).alias("html"))
    rows = rows.select("url", _once(F.regexp_extract_all("html", F.lit(_TAGS), F.lit(0))).alias("tags"))
    hrefs = F.transform(F.filter("tags", lambda t: t.rlike("(?i)^<base")), lambda t: _attribute(t, "href"))
    rows = rows.select("url", F.get(F.filter(hrefs, lambda h: h != ""), F.lit(0)).alias("base"), F.explode("tags").alias("tag"))
    canonical = F.array_contains(F.split(F.lower(_attribute(F.col("tag"), "rel")), r"\s+"), "canonical") & F.col("tag").rlike("(?i)^<link")
    refresh = (F.lower(_attribute(F.col("tag"), "http-equiv")) == "refresh") & F.col("tag").rlike("(?i)^<meta")
    content = F.regexp_extract("tag", r"(?is)[\s\"'/]content\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", 1)
    after = F.regexp_extract(content, r"(?is)^[\"']?\s*[0-9.]*\s*[;,\s]\s*(?:url\s*=\s*)?[\"']?([^\"'\s>]+)", 1)
    named = F.regexp_extract("tag", r"(?i)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)  # of an unquoted content with spaces
    target = F.when(canonical, _attribute(F.col("tag"), "href")).when(refresh, F.when(after != "", after).otherwise(named))
    rows = rows.select("url", "base", _once(target).alias("to")).where("`to` <> ''")
    rows = rows.select("url", _once(F.struct(unescaped(F.col("to")).alias("to"), unescaped(F.col("base")).alias("base"))).alias("v"))
    rows = rows.select("url", "v.to", _once(F.coalesce(resolved(F.col("v.base"), F.col("url")), F.col("url"))).alias("base"))
    rows = rows.select("url", _once(resolved(F.col("to"), F.col("base"))).alias("to")).where("`to` IS NOT NULL")
    return rows.select(node_of(F.col("url")).alias("src"), node_of(F.col("to")).alias("dst")).where("src <> dst")


def _once(value: Column) -> Column:
    """The value by way of a one-element array: what is built on it refers to the column and does not repeat the expression."""
    return F.explode(F.array(value))


def story_redirects(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``from_url, to_url``: every address with a number at the end of its path redirects to one address of that number."""
    number = F.regexp_extract(path_of(F.col(url_col)), "([0-9]+)/?$", 1)
    return pages.select(F.col(url_col).alias("from_url"), number.alias("number")).where("number <> ''").select(
        "from_url", F.concat(F.lit("https://story.example/"), F.col("number")).alias("to_url")
    )


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None,
    id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
) -> DataFrame:
    """``id_col, host, path, rule, verdict``, one row per row of ``pages``.

    A rule of the page's own decides, the longest one that fits. Pages without one take the verdict of
    their aliases: addresses joined by redirects (a table ``from_url, to_url``) and declared canonical
    links, in any number of steps. An alias that an allow rule names makes them allowed, else one that a block
    rule names makes them blocked, else they are allowed. Targets that no page has are judged by the rules too.
    A null url has no host, path or alias. Repeated rows stay, an empty table gives an empty result.
    """
    edges = link_edges(pages, url_col, html_col)
    if redirects is not None:
        known = redirects.where("contains(from_url, '://') AND contains(to_url, '://')")
        edges = edges.unionByName(known.select(node_of(F.col("from_url")).alias("src"), node_of(F.col("to_url")).alias("dst")))
    groups = connected_components(edges)
    address = F.concat(F.lit("://"), F.col("node"))
    ruled = groups.withColumn("own", rule_of(host_of(address), path_of(address), rules)["verdict"])
    # allow sorts before block, so the least verdict of a group is the one that wins
    won = cut_lineage(ruled.groupBy("root").agg(F.min("own").alias("alias_verdict")).where("alias_verdict IS NOT NULL"))
    verdicts = groups.join(won, "root").select("node", "alias_verdict")
    rows = pages.select(
        F.col(id_col), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"),
        F.when(F.contains(F.col(url_col).cast("string"), F.lit("://")), node_of(F.col(url_col))).alias("node"),
    ).withColumn("own", rule_of(F.col("host"), F.col("path"), rules))
    return rows.join(verdicts, "node", "left").select(
        id_col, "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce(F.col("own.verdict"), F.col("alias_verdict"), F.lit("allow")).alias("verdict"),
    )


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, redirected: bool = False) -> str:
    """DuckDB SQL of ``judge_urls`` over ``pages``, with a recursive walk over the links.

    ``redirected`` adds those of ``story_redirects``. Of links in pages it takes the first absolute one of each sort.
    """
    table = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    host = lambda u: f"translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), '{_UPPER}', '{_LOWER}')"
    rest = lambda u, stop: f"regexp_extract({u}, '^.*?://[^/?#]*([^{stop}]*)', 1, 's')"
    best = lambda h, p: f"""(SELECT max_by(struct_pack(r := r.host || r.path, v := r.verdict), length(r.host || r.path)) FROM rules r
      WHERE ({h} = r.host OR ends_with({h}, '.' || r.host)) AND starts_with({p}, r.path))"""  # noqa: E731
    number = f"regexp_extract({rest('url', '?#')}, '([0-9]+)/?$', 1)"
    story = f"UNION SELECT {host('url')} || {rest('url', '#')}, 'story.example/' || {number} FROM pages WHERE contains(url, '://') AND {number} <> ''" if redirected else ""
    return f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {table}),
seen AS (SELECT page_id, coalesce({host('url')}, '') AS host, coalesce({rest('url', '?#')}, '') AS path,
  CASE WHEN contains(url, '://') THEN {host('url')} || {rest('url', '#')} END AS node,
  unnest([regexp_extract(regexp_extract(html, '<link\\b[^>]*\\brel\\s*=\\s*["'']?canonical\\b[^>]*>', 0, 'i'), '\\bhref\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'i'),
          regexp_extract(regexp_extract(html, '<meta\\b[^>]*\\bhttp-equiv\\s*=\\s*["'']?refresh\\b[^>]*>', 0, 'i'), '\\burl\\s*=\\s*["'']?([^"''\\s>]+)', 1, 'i')]) AS target
  FROM pages),
goal AS (SELECT node AS a, {host("replace(target, '&amp;', '&')")} || {rest("replace(target, '&amp;', '&')", '#')} AS b FROM seen WHERE contains(target, '://') AND node IS NOT NULL {story}),
near AS (SELECT a, b FROM goal UNION SELECT b, a FROM goal),
walk AS (SELECT a AS node, a AS other FROM near UNION SELECT w.node, n.b FROM walk w JOIN near n ON w.other = n.a),
alias AS (SELECT node, min({best(host("'://' || other"), rest("'://' || other", '?#'))}.v) AS verdict FROM walk GROUP BY node),
rows AS (SELECT page_id, host, path, any_value(node) AS node FROM (SELECT *, row_number() OVER (PARTITION BY page_id, host, path, node) AS k FROM seen) GROUP BY page_id, host, path)
SELECT page_id, host, path, {best('rows.host', 'rows.path')}.r AS rule,
       coalesce({best('rows.host', 'rows.path')}.v, alias.verdict, 'allow') AS verdict
FROM rows LEFT JOIN alias ON rows.node = alias.node"""
