"""Articles in several parts: nothing outside the skipped parts of their region is lost."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import html_text

LONG = [f"Paragraph {k} of the first part, with quite a few words so that it counts as running text." for k in range(13)]
SHORT = [f"Paragraph {k} of the second part, with quite a few words so that it counts as running text." for k in range(7)]
P = lambda rows: "".join(f"<p>{r}</p>" for r in rows)


def text(body):
    return html_text.main_text(f"<html><body><div class=menu><a href=x>One</a></div>{body}<footer>bye</footer></body></html>").split("\n\n")


@pytest.mark.parametrize("form", [
    "<div id=content><div>%s</div><div>%s</div></div>", "<section>%s</section><section>%s</section>", "<div><section>%s</section><section>%s</section></div>",
    "<table><tr><td>%s</td><td>%s</td></tr></table>", "<article>%s</article><article>%s</article>", "<main>%s</main><div><article>%s</article></div>",
])
def test_parts_65_to_35_are_both_kept(form):
    assert text(form % (P(LONG), P(SHORT))) == LONG + SHORT


def test_heading_and_lead_beside_the_large_part():
    lead = "A lead of some length that introduces the article."
    assert text(f"<div id=content><h1>Heading</h1><p>{lead}</p><div>{P(LONG)}</div></div>") == ["Heading", lead, *LONG]


def test_ends_of_a_page_and_linked_lines_stay():
    body = "<h1>Hi</h1><br>" + P(LONG) + "<p><a href=x>A line that is a link</a></p>" + P(SHORT) + "<p>End</p>"
    assert text(body) == ["Hi", *LONG, "A line that is a link", *SHORT, "End"]
    assert text("<p><a href=x>Only a link, but a long one of some words.</a></p>") == ["Only a link, but a long one of some words."]


def test_menus_beside_articles_stay_out():
    assert text(f"<article>{P(LONG)}<nav>no</nav></article><div><a href=x>x</a></div><article>{P(SHORT)}</article>") == LONG + SHORT


# --- odd markup ---

@pytest.mark.parametrize("page, want", [
    ("<p>a</p><![foo[x]]>", "a"), ("<p>a</p><![ x", "a"), ("<![CDATA[x]]><p>b", "b"), ("<![if IE]><p>y</p><![endif]>", "y"), ("<p>a</p><!-- never closed <p>b", "a"),
    ("<p>a<!--> b</p>", "a b"), ("<p>a<!-- x --!>b</p>", "ab"), ("<?php x ?><p>z", "z"), ("<p>a</p><a href='x", "a"), ("<!doctype html><p>q</p><!bad", "q"), ("</p><p>x</b></i>", "x"),
])
def test_no_markup_raises(page, want):
    assert html_text.main_text(page) == want


@pytest.mark.parametrize("page", [
    "<div>" * 50_000 + "<p>x</p>" + "</div>" * 50_000, "<article>" * 20_000 + "x", "<b>" * 20_000 + "x" + "<div></div>" * 20_000, "<p>x</p>" + "</span>" * 50_000,
    "<p>x</p>" + "<!--" * 50_000, "<p>x</p>" + "<a " * 50_000, "<p>x</p>" + "<li>" * 50_000, "<form>" * 20_000 + "<main>" * 20_000 + "x",
])
def test_time_and_memory_follow_the_page(page):
    import time
    import tracemalloc

    began = time.time()
    assert html_text.main_text(page) == "x"
    assert time.time() - began < 10
    tracemalloc.start()
    html_text.main_text(page)
    assert tracemalloc.get_traced_memory()[1] < 1000 * len(page) ** 0.5 + 150 * len(page)
    tracemalloc.stop()


# --- what stays in an article ---

@pytest.mark.parametrize("page, want", [
    ("<article><header><h1>Title</h1></header><p>Body</p></article>", ["Title", "Body"]),
    ("<article><p class=share>Real words about share prices</p></article>", ["Real words about share prices"]),
    ("<article><div class=share><p>Real words about share prices</p></div></article>", ["Real words about share prices"]),
    ("<article><div class=footer-notes-article><p>Long content</p></div></article>", ["Long content"]),
    ("<article><p>Some words</p><footer>by me</footer></article>", ["Some words"]),
])
def test_names_alone_drop_no_article_text(page, want):
    assert text(page) == want


def test_comments_in_nested_articles_go():
    assert text(f"<article><h1>Top</h1>{P(LONG)}<div id=r><article><p>A reader writes this.</p></article><article><p>Another one too.</p></article></div></article>") == ["Top", *LONG]
    assert text(f"<article class=wrap><p>A lead of a few words.</p><article>{P(LONG)}</article></article>") == ["A lead of a few words.", *LONG]


# --- against a plain version, on random pages without any telling names ---

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def random_page(rng):
    """A tree ``(tag, children or text)`` of a page: menus, a content part or several, lists of links."""
    words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    menu = lambda: (rng.choice(["div", "ul", "section"]), [("li", [("a", words(rng.randint(1, 2)))]) for _ in range(rng.randint(2, 9))])
    prose = lambda: [(rng.choice(["p", "p", "p", "h2", "blockquote"]), words(rng.choice([1, 4, 12, 40, 90]))) for _ in range(rng.randint(1, 7))]
    part = lambda: (rng.choice(["div", "section", "article", "main", "td"][: rng.choice([2, 5])]), prose() + [menu()] * (rng.random() < 0.2) + ([part()] if rng.random() < 0.3 else []))
    return ("body", [x() for x in rng.choices([menu, part, lambda: ("p", words(5)), lambda: ("div", [("p", [("a", words(3))])])], k=rng.randint(1, 6))])


def as_html(node):
    tag, inner = node
    return f"<{tag}>" + (inner if isinstance(inner, str) else "".join(map(as_html, inner))) + f"</{tag}>"


def plain_lines(node):
    """``text, tags, linked, path`` of each line; the path has (number, tag) of every container, outermost first."""
    lines, number = [["", 0, 0, ()]], [0]

    def walk(node, path, linked):
        tag, inner = node
        lines[-1][1] += 1
        if tag in "div section article main td body ul ol table".split():
            number[0] += 1
            path = (*path, (number[0], tag))
        if tag != "a":
            lines.append(["", 0, 0, path])
        for x in [inner] if isinstance(inner, str) else inner:
            if isinstance(x, str):
                lines[-1][0] += x
                lines[-1][2] += len(x) * (linked or tag == "a")
            else:
                walk(x, path, linked or tag == "a")
        lines[-1][1] += 1
        if tag != "a":
            lines.append(["", 0, 0, path if tag not in "div section article main td body ul ol table".split() else path[:-1]])

    walk(node, (), False)
    # an empty line without tags is not begun anew
    return [x for x in lines if x[0]]


def plain_text(node):
    import math

    rows = plain_lines(node)
    if not rows:
        return ""
    raw = [len(t) / max(1, tags) for t, tags, _, _ in rows]
    smooth = []
    for i in range(len(raw)):
        near = [(math.exp(-((i - j) ** 2) / 2), raw[j]) for j in range(max(0, i - 2), min(len(raw), i + 3))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    limit = min(math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth)), max(smooth))
    content = [s >= limit - 1e-9 for s in smooth]
    runs = "".join("x" if c else " " for c in content)
    at = 0
    for run in re.findall("x+| +", runs):  # the ends of a run that do not reach the threshold by themselves
        places = range(at, at + len(run))
        at += len(run)
        strong = [k for k in places if raw[k] >= limit - 1e-9]
        if run[0] == "x" and strong:
            for k in places:
                content[k] = strong[0] <= k <= strong[-1]
    good = [c and linked * 2 <= len(t) for c, (t, _, linked, _) in zip(content, rows)]
    strong = good
    if not any(good):
        good = [linked * 2 <= len(t) for t, _, linked, _ in rows]
    if not any(good):
        good = [True] * len(rows)
    weight = lambda c, marks=good: sum(len(r[0]) for r, g in zip(rows, marks) if g and c in r[3])
    parts = sorted({c for r in rows for c in r[3]})
    articles = [c for c in parts if c[1] in ("article", "main") and weight(c)]
    inside = lambda c, outer: any(c in r[3] and outer in r[3][: r[3].index(c)] for r in rows)
    if articles:
        best = max(articles, key=lambda c: (weight(c), c[1] == "article", c))
        region = [c for c in articles if c == best or not inside(best, c)]
        lost = []
        for c in parts:
            outer = [o for o in region if o[1] == "article" and inside(c, o)]
            if c[1] == "article" and outer:
                nearest = max(outer)
                inner = [x for x in parts if x[1] == "article" and inside(x, nearest) and not any(inside(x, o) for o in region if o[1] == "article" and inside(o, nearest))]
                if weight(nearest) - sum(map(weight, inner)) >= weight(c):
                    lost.append(c)
    else:
        total = sum(len(r[0]) for r, g in zip(rows, good) if g)
        region, lost = [max(c for c in parts if c[1] in "body div section td".split() and weight(c) == total)], []
        if region[0][1] == "body":
            lost = [c for c in parts if c[1] != "body" and not weight(c, strong) and 2 * sum(r[2] for r in rows if c in r[3]) > sum(len(r[0]) for r in rows if c in r[3])]
    return "\n\n".join(t for t, _, _, path in rows if any(c in path for c in region) and not any(c in path for c in lost))


def test_random_pages_equal_plain_version(monkeypatch):
    import random

    rng = random.Random(5)
    pages = [random_page(rng) for _ in range(1500)]
    found = [html_text.main_text(as_html(p)) for p in pages]
    for page, got in zip(pages, found):
        assert got == plain_text(page), as_html(page)
    monkeypatch.setattr(html_text, "content_lines", lambda values: values > -1)
    monkeypatch.setattr(html_text, "without_edges", lambda content, own: content)
    unclustered = sum(html_text.main_text(as_html(p)) != f for p, f in zip(pages, found))
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "smoothed", lambda values: values)
    unsmoothed = sum(html_text.main_text(as_html(p)) != f for p, f in zip(pages, found))
    assert unclustered > 150 and unsmoothed > 10, (unclustered, unsmoothed)


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<div class=a7>%s</div>", "<section>%s</section>", "<table><tr><td>%s</td></tr></table>"])
def test_marked_pages(wrap):
    """Articles between unnamed menus and link lists: the clusters alone find them."""
    import random

    rng = random.Random(7)
    exact = 0
    for _ in range(200):
        words = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
        blocks = [words(rng.choice([3, 30, 60, 120])) for _ in range(rng.randint(3, 12))]
        menu = lambda: "<div><ul>" + "".join(f"<li><a href=x>{words(2)}</a></li>" for _ in range(rng.randint(4, 12))) + "</ul></div>"
        got = html_text.main_text(f"<body><div><a href=x>{words(2)}</a></div>{menu()}{wrap % P(blocks)}{menu()}<footer>{words(9)}</footer></body>")
        exact += got == "\n\n".join(blocks)
    assert exact >= 190, exact


# --- a held-out labelled set: no telling tags, no telling names ---


def labelled_page(seed):
    """A page of anonymous parts and the blocks of its article: link lists and scraps of marked-up words around headings, paragraphs and lists."""
    rng = random.Random(seed)
    vocabulary = [a + b for a in "ba ce di fo gu la me ni po ru sa te".split() for b in "ban cer dol fin gos lam mer nit por sun".split()]
    want = []

    def words(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    def name():
        return rng.choice(["", f' class="c{rng.randrange(99)}"', f' id="x{rng.randrange(999)}"', f' class="{rng.choice("abcdefgh")}{rng.randrange(9)} k"'])

    def said(n):
        want.append(words(n) + ".")
        return want[-1]

    def links():
        if rng.random() < 0.4:
            return f"<ul{name()}>" + "".join(f'<li><a href="/{k}">{words(rng.randrange(1, 5))}</a></li>' for k in range(rng.randrange(3, 12))) + "</ul>"
        gap = rng.choice([" ", "<br>", " | "])
        return f"<{(tag := rng.choice(['div', 'p']))}{name()}>" + gap.join(f'<a href="/{k}"><span>{words(rng.randrange(1, 4))}</span></a>' for k in range(rng.randrange(3, 9))) + f"</{tag}>"

    def scraps():
        return f"<div{name()}>" + "".join(f"<div{name()}><span><b>{words(1)}</b></span> <i>{rng.randrange(99)}</i> <span>{words(rng.randrange(2, 6))}</span></div>" for _ in range(rng.randrange(1, 5))) + "</div>"

    def block():
        kind = rng.random()
        if kind < 0.75:
            return f"<p>{said(rng.randrange(15, 90))}</p>"
        if kind < 0.87:
            return f"<h2>{said(rng.randrange(2, 6))}</h2><p>{said(rng.randrange(24, 54))}</p>"
        return f"<ul{name()}>" + "".join(f"<li>{said(rng.randrange(6, 12))}</li>" for _ in range(rng.randrange(2, 5))) + "</ul>"

    blocks = [f"<h1>{said(rng.randrange(4, 9))}</h1>"] * (rng.random() < 0.7) + [block() for _ in range(rng.randrange(3, 9))]
    half = len(blocks) // 2 if rng.random() < 0.3 else 0
    inner = f"<div{name()}>{''.join(blocks[:half])}</div><div{name()}>{''.join(blocks[half:])}</div>" if half else "".join(blocks)
    article = f"<div{name()}>{inner}</div>"
    around = lambda n: "".join(rng.choice([links, scraps])() for _ in range(n))
    if rng.random() < 0.5:
        article = f"<div{name()}>{article}<div{name()}>{around(1)}</div></div>"
    return f"<html><head><title>t</title></head><body>{around(rng.randrange(1, 4))}{article}{around(rng.randrange(1, 5))}</body></html>", want


def precision_and_recall(pages):
    both = got = wanted = 0
    for html, want in pages:
        a, b = Counter(html_text.main_text(html).split()), Counter(" ".join(want).split())
        both, got, wanted = both + sum((a & b).values()), got + sum(a.values()), wanted + sum(b.values())
    return both / got, both / wanted


def test_unnamed_pages_by_the_clusters(monkeypatch):
    """Word precision and recall; without the clusters only the lists of tags and names are left, which say nothing here."""
    pages = [labelled_page(seed) for seed in range(400)]
    precision, recall = precision_and_recall(pages)
    assert precision > 0.99 and recall > 0.99, (precision, recall)
    monkeypatch.setattr(html_text, "content_lines", lambda values: values > -1)
    monkeypatch.setattr(html_text, "without_edges", lambda content, own: content)
    off, _ = precision_and_recall(pages)
    assert off < precision - 0.1, off
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "without_edges", lambda content, own: content)
    smeared, _ = precision_and_recall(pages)
    assert smeared < precision - 0.01, smeared
    print("precision", precision, "recall", recall, "clusters off", off, "edges kept", smeared)
