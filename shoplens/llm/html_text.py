"""Main text of raw HTML by line-block distribution.

Markup is stripped and each block of a page becomes a line, the edge of a container an
empty one. A line's weight is the length of its text; menus, notices, adverts, forms,
comments and the like, told by their element, role, class or id, weigh nothing, and
neither does a line that is mostly links. Weights are summed over a sliding window of
lines: the text surges where the sum first rises to a threshold and dives where it next
falls to nothing. What lies between is kept. A page with an ``article`` or ``main``
element that holds a fair part of the text has weights inside it only; there the smallest
surge counts, so that short paragraphs and headings of the article stay.

Markup is read as browsers do: raw text of scripts and styles, unquoted attributes, end
tags left out, comments and tags that never end (the rest of the page). Time grows with
the length of a page. Defined results: a null or empty page, or one without text, gives
an empty text; nothing is cut; character references without a semicolon are decoded as
HTML allows; any Unicode white space inside a block counts as such.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WINDOW = 3  # lines that are summed
SURGE = 86  # characters in a window at which text outside of an article element begins
LARGE = 0.2  # a stretch of text counts beside the largest one from this share on
FAIR = 0.25  # an article element counts from this share of the page's text on

# Elements of HTML by their kind.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea noscript iframe noframes noembed xmp template svg math object canvas audio video select button".split())
_ARTICLE = frozenset("article main".split())
_ASIDE = frozenset("nav aside footer menu dialog datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre search section summary table caption tbody tfoot thead tr ul".split())
_CONTAINER = frozenset("article aside div dl fieldset footer form header main menu nav ol section table ul".split())
_IMPLIED = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"})}
# Names in class and id, and roles, that mark what is no article text.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion nav navbar navigation navi menu submenu "
    "breadcrumb breadcrumbs crumbs sidebar sidebars rail footer foot masthead topbar toolbar comment comments commentlist disqus respond replies "
    "cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations pagination pager paging skiplink".split())
_PAIRS = frozenset({("side", "bar"), ("skip", "link"), ("read", "more"), ("see", "also")})
_OUTER_NAMES = frozenset("header banner search".split())
_COMMENTS = frozenset("comment comments commentlist disqus respond replies".split())
_ROLES = frozenset("navigation contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+'|)|["'])*+)>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]*)))?""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ANY, _ARTICLE_ONLY, _COMMENT = 1, 2, 3  # why text is left out: anything, unless an article element begins inside, a comment


def _marks(attributes: str) -> tuple[set[str], bool, str]:
    """Names in class and id, whether it is hidden, and the role."""
    names: set[str] = set()
    hidden, role = False, ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "")
        if name in ("class", "id"):
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                names.update(words)
                names.update(a + b for a, b in zip(words, words[1:]) if (a, b) in _PAIRS)
        elif name == "role":
            role = value.lower()
        elif name == "style":
            hidden |= "display:none" in value.lower().replace(" ", "")
        else:
            hidden |= name == "hidden" or value.lower() == "true"
    return names, hidden, role


def _left_out(tag: str, attributes: str, in_article: bool, forms: bool) -> int:
    """Why the text of an element is left out, or 0; with ``forms`` that of a form is not."""
    if tag in _ASIDE:
        return _ANY if tag in ("aside", "footer", "dialog", "datalist") else _ARTICLE_ONLY
    if tag == "search" or (tag == "header" and not in_article) or (tag == "form" and not forms):
        return _ARTICLE_ONLY
    if not attributes:
        return 0
    names, hidden, role = _marks(attributes)
    if names & _COMMENTS:
        return _COMMENT
    if hidden:
        return _ANY
    if tag in ("html", "body") or tag in _ARTICLE:
        return _ANY if tag in _ARTICLE and names & (_NAMES - {"main"}) else 0
    if names & _NAMES or names & {"sidebar", "skiplink", "readmore", "seealso"} or role in _ROLES:
        return _ARTICLE_ONLY
    return _ARTICLE_ONLY if not in_article and (names & _OUTER_NAMES or role == "banner") else 0


class _Lines:
    """Lines of a page: text, its weight, and the number of the article element it lies in (0: none)."""

    def __init__(self, forms: bool) -> None:
        self.forms = forms
        self.lines: list[tuple[str, int, int]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.stack: list[tuple[str, int, int]] = []  # element, why left out, article number
        self.open: Counter[str] = Counter()
        self.why = self.article = self.articles = 0
        self.link = False

    def text(self, raw: str) -> None:
        if not self.why:
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.link:
                self.linked += len(text.strip())

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            if text:
                self.lines.append((text, 0 if 2 * self.linked > len(text) else len(text), self.article))
            self.parts, self.linked = [], 0

    def edge(self) -> None:
        self.lines.append(("", 0, self.article))

    def push(self, tag: str, why: int) -> None:
        self.stack.append((tag, self.why, self.article))
        self.open[tag] += 1
        if tag in _ARTICLE:
            if self.why == _ARTICLE_ONLY:
                self.why = 0
            if not self.article and not self.why and not why:
                self.articles += 1
                self.article = self.articles
        self.why = self.why or why

    def pop_to(self, tag: str) -> None:
        while True:
            last, self.why, self.article = self.stack.pop()
            self.open[last] -= 1
            if last == tag:
                return

    def imply(self, tag: str) -> None:
        """Close what the start of a block closes: an open paragraph, a list item before the next one."""
        if self.open["p"] and self.stack[-1][0] == "p":
            self.pop_to("p")
        ends, stops = _IMPLIED.get(tag, ("", frozenset()))
        if ends and any(self.open[e] for e in ends.split()):
            for name, _, _ in reversed(self.stack):
                if name in ends.split():
                    self.pop_to(name)
                    return
                if name in stops:
                    return

    def start(self, tag: str, attributes: str) -> None:
        block = tag in _BLOCK
        why = _left_out(tag, attributes, self.article > 0, self.forms)
        if block:
            self.end_line()
            self.imply(tag)
        elif why:
            while self.stack and self.stack[-1][0] not in _BLOCK:  # elements in a line close in any order
                self.pop_to(self.stack[-1][0])
        if tag == "a":
            self.link = "href" in attributes
        elif tag in ("br", "td", "th"):
            self.text(" ")
        if tag in _VOID or not (block or why):
            return
        if tag in _CONTAINER:
            self.edge()
        self.push(tag, why)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.link = False
        if tag in _BLOCK:
            self.end_line()
            if self.open[tag]:
                self.pop_to(tag)
            if tag in _CONTAINER:
                self.edge()
            self.link = False
        elif self.stack and self.stack[-1][0] == tag:
            self.pop_to(tag)


def page_lines(html: str, forms: bool = False) -> list[tuple[str, int, int]]:
    """Lines of a page in order: text, weight, article number; edges of containers are empty lines."""
    lines, at, size = _Lines(forms), 0, len(html)
    while at < size:
        mark = html.find("<", at)
        if mark < 0:
            mark = size
        if mark > at:
            lines.text(html[at:mark])
        if mark == size:
            break
        found = _TAG.match(html, mark)
        if found:
            at, tag = found.end(), found[2].lower()
            if found[1]:
                lines.end(tag)
            elif tag in _RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                at = size if close is None else html.find(">", close.end())
                at = size if at < 0 else at + (close is not None)
            else:
                lines.start(tag, found[3])
        elif html.startswith("<!--", mark):
            at = html.find("-->", mark + 2) + 3 if not html.startswith(("<!-->", "<!--->"), mark) else html.find(">", mark) + 1
            at = size if at < mark + 3 else at
        elif html.startswith(("<!", "<?", "</"), mark):
            at = html.find(">", mark) + 1 or size
        elif html[mark + 1 : mark + 2].isascii() and html[mark + 1 : mark + 2].isalpha():
            break  # a tag that never ends
        else:
            lines.text("<")
            at = mark + 1
    lines.end_line()
    return lines.lines


def surges(weights: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int, int]]:
    """First line, line after the last one, and weight of each stretch between a surge and the next dive of the window's sum."""
    found, start, total, ahead = [], -1, 0, sum(weights[:window])
    for i, weight in enumerate(weights):
        if start < 0 and ahead >= threshold and weight:
            start, total = i, 0
        if start >= 0:
            total += weight
            if not ahead:
                found.append((start, i, total))
                start = -1
        ahead += (weights[i + window] if i + window < len(weights) else 0) - weight
    return found + ([(start, len(weights), total)] if start >= 0 else [])


def main_text(html: str | None) -> str:
    """The blocks of the main text, one blank line between them."""
    lines = page_lines(html or "")
    whole, inside = sum(w for _, w, _ in lines), Counter()
    if html and "<form" in html.lower():  # some pages are one form with the article in it
        other = page_lines(html, forms=True)
        if whole < FAIR * sum(w for _, w, _ in other):
            lines, whole = other, sum(w for _, w, _ in other)
    for text, _, article in lines:
        if article:
            inside[article] += len(text)
    largest = max(inside.values(), default=0)
    if largest and largest >= FAIR * whole:
        chosen = {a for a, n in inside.items() if n >= largest / 2}
        weights, threshold, share = [len(text) if article in chosen else 0 for text, _, article in lines], 1, 0.0
    else:
        weights, threshold, share = [w for _, w, _ in lines], SURGE, LARGE
        top = max((sum(weights[i : i + WINDOW]) for i in range(len(weights))), default=0)
        threshold = max(1, min(threshold, top))
    stretches = surges(weights, threshold)
    least = share * max((n for _, _, n in stretches), default=0)
    kept = [lines[i][0] for a, b, n in stretches if n >= least for i in range(a, b) if weights[i] or (share and lines[i][0])]
    return "\n\n".join(kept)


@F.pandas_udf(StringType())
def _main_text(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def extract_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text of ``html`` in the column ``into``."""
    return pages.withColumn(into, _main_text(F.coalesce(F.col(html), F.lit(""))))
