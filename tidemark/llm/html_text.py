"""Main text of web pages from parser events, text-to-tag ratios and their clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import sliced

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that can be the region, and those that are told apart as parts of a page.
_CONTAINER = frozenset("article body div main section td".split())
_PARTS = _CONTAINER | frozenset("center details dl fieldset header ol table ul".split())
#: A new one ends an open one of the same group inside the nearest element that can hold both.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDERS = frozenset("ul ol menu dl table tbody thead tfoot select".split())
#: Elements and roles whose content is not the article's, wherever they stand.
_SKIP_TAGS = frozenset("nav footer aside form script style noscript template head title button select textarea input iframe svg canvas object audio video dialog menu".split())
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: An article inside one of these was put there by a wrapper or by a tag that was never closed.
_WRAPS = frozenset("form nav".split())
#: Names (class or id) of parts that are not the article's: one of these words and otherwise only neutral ones.
_PART_WORDS = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets footer cookie cookies consent gdpr notice notices notification alert popup "
    "modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending comment comments "
    "commentlist disqus reply replies respond responses discussion pagination pager skip toolbar".split()
)
_HEADER_WORDS = frozenset("header masthead".split())
_NEUTRAL_WORDS = frozenset(
    "a and area article bar block body bottom box button buttons col container fixed global inner item items js left links list main the outer page panel post "
    "primary right row secondary section site sticky text top wrap wrapper".split()
)
#: In elements that are no parts, such as a comment in highlighted code, only adverts count.
_AD_WORDS = frozenset("ad ads advert advertisement sponsored".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_COMMENT_END = re.compile("--!?>")

PLAIN, PART, HEADER, SKIPPED = range(4)


class Line:
    """A run of text between block boundaries, with the innermost part of the page that it lies in."""

    __slots__ = ("text", "tags", "linked", "skipped", "node")

    def __init__(self, node: int, skipped: bool) -> None:
        self.text: list[str] = []
        self.tags = self.linked = 0
        self.skipped, self.node = skipped, node


def _named(value: str, words: frozenset[str]) -> bool:
    """Whether one of the names in a class or id is made of ``words`` and neutral ones."""
    for token in value.split():
        found = [w.lower() for w in _WORD.findall(token)]
        if not words.isdisjoint(found) and all(w in words or w in _NEUTRAL_WORDS for w in found):
            return True
    return False


def _kind(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    if tag in _SKIP_TAGS:
        return SKIPPED
    kind = HEADER if tag == "header" else PLAIN
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return SKIPPED
        if name == "role" and value.lower() in _SKIP_ROLES:
            return SKIPPED
        if name == "style" and "display:none" in value.lower().replace(" ", ""):
            return SKIPPED
        if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
            if tag not in _PARTS:
                if _named(value, _AD_WORDS):
                    return SKIPPED
            elif _named(value, _HEADER_WORDS):
                kind = HEADER
            elif kind == PLAIN and _named(value, _PART_WORDS | _HEADER_WORDS):
                kind = PART
    return kind


class _Lines(HTMLParser):
    """Cuts the events of a page into lines and numbers its parts as they open.

    A line holds its part's number and a part its parent's, so memory grows with the page and not with its
    nesting. Steps that look up the stack close what they pass, or are saved by counts of open elements.
    """

    def __init__(self, forms: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.forms = forms  # whether forms count as content
        self.tags, self.parents, self.kinds = ["page"], [0], [PLAIN]
        self.node = 0
        self.lines: list[Line] = [Line(0, False)]
        self.stack: list[list] = []  # tag, part around it, whether skipped
        self.open: Counter[str] = Counter()
        self.skips = self.wrapped = 0  # open skipped elements, and those of them in _WRAPS
        self.muted = 0  # open skipped elements that do not break a line, such as a script in a paragraph

    # Markup that the parser would raise on or look through again and again: a browser takes it for a comment.

    def parse_comment(self, i: int, report: int = 1) -> int:
        for short in (">", "->"):
            if self.rawdata.startswith(short, i + 4):
                return i + 4 + len(short)
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return end.end() if end else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        return self.rawdata.find(">", i + 2) + 1 or len(self.rawdata)

    parse_pi = parse_html_declaration

    def parse_starttag(self, i: int) -> int:
        if i > self.last_close:
            return len(self.rawdata)
        return super().parse_starttag(i)

    def parse_endtag(self, i: int) -> int:
        if i > self.last_close:
            return len(self.rawdata)
        return super().parse_endtag(i)

    def read(self, html: str) -> None:
        self.last_close = html.rfind(">")  # no tag begun after it ends
        self.feed(html)
        self.close()

    def _break(self) -> None:
        if self.lines[-1].text or self.lines[-1].tags:
            self.lines.append(Line(self.node, self.skips > 0))
        else:
            self.lines[-1].node, self.lines[-1].skipped = self.node, self.skips > 0

    def _close(self, count: int) -> None:
        for tag, _, skipped in self.stack[count:]:
            self.open[tag] -= 1
            self.skips -= skipped
            self.wrapped -= skipped and tag in _WRAPS
            self.muted -= skipped and tag not in _BLOCK
        self.node = self.stack[count][1]
        del self.stack[count:]

    def _up_to(self, wanted, stop) -> int | None:
        """The place of the innermost open element of ``wanted`` if none of ``stop`` lies above it."""
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in wanted:
                return k
            if self.stack[k][0] in stop:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.lines[-1].tags += 1
        if tag == "br":
            self.handle_data(" ")
        if tag in _VOID:
            if tag in _BLOCK:
                self._break()
            return
        if tag in _BLOCK:
            if self.open["head"] and tag not in ("html", "title"):
                self._close(next(k for k, (t, _, _) in enumerate(self.stack) if t == "head"))
            if tag in ("article", "main") and self.wrapped:
                for entry in self.stack:
                    if entry[2] and entry[0] in _WRAPS:
                        entry[2] = False
                        self.skips -= 1
                self.wrapped = 0
            if self.open["p"] and (k := self._up_to(("p",), _BLOCK)) is not None:  # a block ends an open paragraph
                self._close(k)
        if tag in _SIBLINGS and any(self.open[t] for t in _SIBLINGS[tag]) and (k := self._up_to(_SIBLINGS[tag], _HOLDERS)) is not None:
            self._close(k)
        kind = _kind(tag, attrs)
        skipped = kind == SKIPPED and not (self.forms and tag == "form")
        self.stack.append([tag, self.node, skipped])
        self.open[tag] += 1
        self.skips += skipped
        self.wrapped += skipped and tag in _WRAPS
        self.muted += skipped and tag not in _BLOCK
        if tag in _PARTS and not self.skips:
            self.parents.append(self.node)
            self.node = len(self.tags)
            self.tags.append(tag)
            self.kinds.append(kind)
        if tag in _BLOCK:
            self._break()

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in ("div", "p", "span", "b", "i", "a", "section", "article"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1].tags += 1
        if not self.open[tag]:
            return
        k = self._up_to((tag,), ())
        block = any(t in _BLOCK for t, _, _ in self.stack[k:])
        self._close(k)
        if block:
            self._break()

    def handle_data(self, data: str) -> None:
        line = self.lines[-1]
        if self.muted or line.skipped:
            return
        line.text.append(data)
        if self.open["a"]:
            line.linked += len(data)


def ratios(lengths: list[int], tags: list[int]) -> np.ndarray:
    """Characters per tag of each line; a line without a tag counts as having one."""
    return np.array(lengths, float) / np.maximum(1, np.array(tags, float))


def smoothed(values: np.ndarray, radius: int = 2) -> np.ndarray:
    """A Gaussian of the given radius over the lines, cut off at the page's ends."""
    offsets = np.arange(-radius, radius + 1)
    kernel = np.exp(-(offsets**2) / (2 * (radius / 2) ** 2))
    weights = np.convolve(np.ones(len(values)), kernel, "full")[radius : radius + len(values)]
    return np.convolve(values, kernel, "full")[radius : radius + len(values)] / weights


def content_lines(values: np.ndarray) -> np.ndarray:
    """Two clusters of smoothed ratios by a threshold: their standard deviation, or lower if none reaches it."""
    if not len(values):
        return np.zeros(0, bool)
    return values >= min(values.std(), values.max())


def without_edges(content: np.ndarray, own: np.ndarray) -> np.ndarray:
    """``content`` without the lines at the ends of a run that do not reach the threshold by themselves (``own``), unless none of the run does.

    Smoothing lifts short lines among long ones over the threshold, and likewise the menu line beside the first paragraph, which this gives back.
    """
    kept = content.copy()
    begins = np.flatnonzero(content & ~np.concatenate([[False], content[:-1]]))
    ends = np.flatnonzero(content & ~np.concatenate([content[1:], [False]]))
    for begin, end in zip(begins, ends):
        strong = np.flatnonzero(own[begin : end + 1])
        if len(strong):
            kept[begin : begin + strong[0]] = False
            kept[begin + strong[-1] + 1 : end + 1] = False
    return kept


def main_text(html: str) -> str:
    """The article's blocks, joined by empty lines; empty if the page has none.

    Lines are clustered by their smoothed text-to-tag ratios, and the content cluster chooses the region: the article
    or main elements that hold content lines, or without any the smallest container around all content lines. Content lines
    that are mostly links, or stand in a header or a part whose name is unmistakably a menu, advert, comment list and
    the like, do not choose; a part with over half of all content text is no such part, whatever its name.

    All of the region is kept, but for such parts, articles within an article that has as much content
    of its own (reader comments), and, where the region is the whole page, its header and parts without a content line that
    are mostly links. Menus, footers, asides, forms and scripts are never read. A page whose text is all in forms is
    read with them.
    """
    return _region_text(html, False) or ("<form" in html.lower() and _region_text(html, True)) or ""


def _sums(weights: list[tuple[int, int]], parents: list[int]) -> list[int]:
    """Per part the weight of its lines and of all parts in it."""
    total = [0] * len(parents)
    for node, weight in weights:
        total[node] += weight
    for c in range(len(parents) - 1, 0, -1):
        total[parents[c]] += total[c]
    return total


def _below(marked: list[bool], parents: list[int]) -> list[bool]:
    """Marks handed down to all parts inside."""
    out = list(marked)
    for c in range(1, len(parents)):
        out[c] = out[c] or out[parents[c]]
    return out


def _region_text(html: str, forms: bool) -> str:
    page = _Lines(forms)
    page.read(html)
    lines, texts = [], []
    for line in page.lines:
        if not line.skipped and line.text and (text := " ".join("".join(line.text).split())):
            lines.append(line)
            texts.append(text)
    if not lines:
        return ""
    tags, parents, kinds = page.tags, page.parents, page.kinds
    size = [len(t) for t in texts]
    raw = ratios(size, [line.tags for line in lines])
    values = smoothed(raw)
    content = without_edges(content_lines(values), raw >= min(values.std(), values.max())).tolist()
    prose = [line.linked * 2 <= n for line, n in zip(lines, size)]
    held = _sums([(line.node, n) for line, n, c, p in zip(lines, size, content, prose) if c and p], parents)
    part = _below([k == PART and 2 * w <= held[0] for k, w in zip(kinds, held)], parents)
    header = _below([k == HEADER for k in kinds], parents)

    apart = [part[line.node] or header[line.node] for line in lines]
    for good in (
        [c and p and not a for c, p, a in zip(content, prose, apart)], [p and not a for p, a in zip(prose, apart)], [not a for a in apart],
    ):
        if any(good):
            break
    else:
        return ""
    weight = _sums([(line.node, n) for line, n, g in zip(lines, size, good) if g], parents)
    articles = [c for c, t in enumerate(tags) if t in ("article", "main") and weight[c]]
    region, dropped = [False] * len(tags), [False] * len(tags)
    whole_page = False
    if articles:
        best = max(articles, key=lambda c: (weight[c], tags[c] == "article", c))
        around, c = {0}, best
        while c:
            around.add(c)
            c = parents[c]
        for c in articles:
            region[c] = c == best or c not in around
        outer_of = _around([r and t == "article" for r, t in zip(region, tags)], parents)
        nested: dict[int, list[int]] = {}
        for c, outer in enumerate(outer_of):
            if tags[c] == "article" and outer:
                nested.setdefault(outer, []).append(c)
        for outer, inner in nested.items():
            own = weight[outer] - sum(weight[c] for c in inner)
            for c in inner:
                dropped[c] = own >= weight[c]
    else:
        chosen = max((c for c, t in enumerate(tags) if t in _CONTAINER and weight[c] == weight[0]), default=0)
        region[chosen] = True
        if whole_page := tags[chosen] in ("page", "body"):
            chars = _sums([(line.node, n) for line, n in zip(lines, size)], parents)
            linked = _sums([(line.node, min(n, line.linked)) for line, n in zip(lines, size)], parents)
            dropped = [c != chosen and tags[c] != "body" and not held[c] and 2 * linked[c] > chars[c] for c in range(len(tags))]
            dropped[0] = False
    region, dropped = _below(region, parents), _below(dropped, parents)
    return "\n\n".join(
        t for t, line in zip(texts, lines)
        if region[c := line.node] and not dropped[c] and not part[c] and not (whole_page and header[c])
    )


def _around(marked: list[bool], parents: list[int]) -> list[int]:
    """For each part the nearest marked one around it, 0 if none."""
    out = [0] * len(parents)
    for c in range(1, len(parents)):
        out[c] = parents[c] if marked[parents[c]] else out[parents[c]]
    return out


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text, n_chars``: one row per row of ``pages``.

    A null or empty page has an empty text. Pages are read whole, however long, nested or broken; repeated rows get
    equal results, an empty table gives none, other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 2):
            texts = [main_text(h.as_py()) for h in part.column(2)]
            columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.record_batch(columns, names=[id_col, url_col, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in (id_col, url_col))
    page = F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("__html")
    return pages.select(F.col(id_col), F.col(url_col), page).mapInArrow(run, f"{kinds}, text string, n_chars long")
