"""Main text of web pages by tag-path ratios.

A page is read once into its text blocks. All blocks of a path of block tags from the root are
weighed together: how much text and how much punctuation its nodes hold on average, less what is
link text. The two ratios are fused by their geometric mean, smoothed along the page, and averaged
by path again. Paths that reach a share of the mean, weighted by text, tell where the content is:
the container is the innermost element that holds most of their text. In it everything stays but
lists of links and what is named as something else and has a low ratio; outside of it only paths
of a high ratio stay, and the heading before it.

Marks are evidence that weighs in: text in a marked article counts double for the container, text
in an element named as something else (by class or id) counts little, unless the element is a
wrapper of the main article or of most of the page's text. Only what a page marks by tag or role
as never content (navigation, footers, forms and so on) is not looked at.

All steps take time and memory in proportion to the page: elements, paths and marks are numbers
with their parents', and sums go from each element to its parent once.
"""

from __future__ import annotations

import html
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

SMOOTH = 1.0
#: Share of the mean ratio that tells content, and the larger one of paths outside of the container.
SHARE, OUTSIDE = 0.35, 0.75
#: Share of the container's text that a path outside of it has at least, its nodes taken together.
PART = 0.2
#: Share of the mean ratio that named elements need in the container, after their weights.
INSIDE = 0.15
#: Weights of text in elements named as something else: by a whole name, by a part of one, or as
#: what is never part of an article; and how much more text counts in a marked article, or beside
#: the page's first heading, when the container is sought.
NAMED, PARTLY, NEVER, MARKED = 0.15, 0.2, 0.02, 2.0
#: The container holds so much of the content's text.
MOST = 0.8
LINKS = 0.6

# The tags of the HTML standard by their role.
_RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object", "canvas"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
_CONTAINERS = {"", "html", "body", "div", "section", "article", "main", "center", "table", "tbody", "tr", "td"}
_ASIDE = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "fieldset", "audio", "video", "datalist"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPES = {"ul", "ol", "dl", "table", "div", "article", "section", "main", "aside", "nav", "footer", "header", "body", "blockquote", "form"}

#: A quote opens a value only after an equals sign, and only if it is closed before the next tag or
#: in front of a space or the tag's end. No part of the pattern is tried twice.
_VALUE = r"=\s*+(?:\"[^\"<]*+\"|'[^'<]*+'|\"[^\"]*+\"(?=\s|/?>)|'[^']*+'(?=\s|/?>))"
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|" + _VALUE + r"|=)*+)>|([^<]+|<)", re.S)
_CUT = re.compile(r"</?[a-zA-Z]")
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in sorted(_RAW)}
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar", "toolbar"}
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|banner|breadcrumbs?|byline-share|comments?|commentlist|consent|cookies?|disqus|feedback|footer|header|masthead|menu|menubar"
    r"|modal|nav|navbar|navigation|newsletter|notices?|outbrain|overlay|pagination|pager|popup|promos?|recommended|related|replies|reply|respond|share|sharing|sidebar|skip|skip-link|social|sponsor(?:ed)?|subscribe|taboola|toolbar|widgets?)(?:$|[\s_-])",
    re.I,
)
_STRONG = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|menu|menubar|modal|nav|navbar|navigation|overlay"
    r"|pagination|pager|popup|replies|reply|respond|sidebar|sponsor(?:ed)?|toolbar)(?:$|[\s_-])",
    re.I,
)
_ARTICLE = re.compile(r"(?:^|[\s_-])(?:article-?body|article-?content|entry-?content|post-?body|post-?content|main-?content|story-?body)(?:$|[\s_-])", re.I)
_OWN_HEADER = re.compile(r"(?:^|\s)(?:article|entry|post|story)[_-]?header(?:$|\s)", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")


#: What elements are marked as: something else by a whole name, by a part of one, or as what is
#: never part of an article; or the article, or the main element.
_NAME_MARK, _PART_MARK, _NEVER_MARK, _ARTICLE_MARK, _MAIN_MARK = range(1, 6)
_WEIGHT = {_NAME_MARK: NAMED, _PART_MARK: PARTLY, _NEVER_MARK: NEVER}


def _named(value: str) -> int:
    """Whether a name, or only a part of one, says that an element is something else."""
    if not _NAMED.search(value):
        return 0
    if not any(all(_NAMED.search(part) for part in re.split("[_-]", name)) for name in value.split()):
        return _NEVER_MARK if re.search(r"(?:^|\s)comments?[_-]", value, re.I) else _PART_MARK
    return _NEVER_MARK if _STRONG.search(value) else _NAME_MARK


def _role(tag: str, attributes: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is never content, and what it is marked as (0 for nothing)."""
    aside, article, main, named = tag in _ASIDE, tag in ("article", "main"), tag == "main", 0
    if attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            name, value = (m[1] or m[5]).lower(), m[2] or m[3] or m[4] or ""
            if name in ("class", "id"):
                article |= bool(_ARTICLE.search(value) or _OWN_HEADER.search(value))
                if tag not in ("html", "body", "article", "main") and (mark := _named(value)):
                    named = max(named, mark)
            elif name == "role":
                aside |= value.lower() in _ROLES
                article |= value.lower() in ("main", "article")
                main |= value.lower() == "main"
            elif name == "itemprop":
                article |= value.lower() == "articlebody"
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                aside = True
    if tag == "header" and not in_article and not article:
        named = max(named, _NAME_MARK)
    return aside, _MAIN_MARK if main else _ARTICLE_MARK if article else named


class Page:
    """A page's elements, each with its parent's number, and its text blocks in order.

    Unclosed and stray tags are mended. Element 0 is the root. Inline elements are none, unless
    they are marked as something else.
    """

    def __init__(self, page: str):
        self.tag, self.parent, self.path, self.mark = [""], [-1], [0], [0]
        self.aside, self.in_article = [False], [False]
        #: Of each text block: its element, its pieces of text, and how many characters are link text.
        self.of: list[int] = []
        self.text: list[list[str]] = []
        self.linked: list[int] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._stack = [0]
        self._places: dict[str, list[int]] = {}  # of the open elements of a tag, in the stack
        self._read(page)

    def _open(self, tag: str, label: str, aside: bool, mark: int) -> None:
        up, n = self._stack[-1], len(self.tag)
        self.tag.append(tag)
        self.parent.append(up)
        self.path.append(self._paths.setdefault((self.path[up], label), len(self._paths) + 1))
        self.mark.append(mark)
        self.aside.append(self.aside[up] or aside)
        self.in_article.append(self.in_article[up] or mark in (_ARTICLE_MARK, _MAIN_MARK))
        self._places.setdefault(tag, []).append(len(self._stack))
        self._stack.append(n)

    def _close(self, depth: int) -> None:
        """Close the open elements from this place in the stack on."""
        while len(self._stack) > depth:
            self._places[self.tag[self._stack.pop()]].pop()

    def _last(self, tags) -> int:
        return max((at[-1] for t in tags if (at := self._places.get(t))), default=0)

    def _read(self, page: str) -> None:
        now, links, pos, end, last = False, 0, 0, len(page), page.rfind(">")
        while pos < end:
            if pos > last and _CUT.match(page, pos):  # a tag that the page's end cuts
                break
            m = _TOKEN.match(page, pos)
            pos = m.end()
            if m[4] is not None:
                if not now:
                    if m[4].isspace():
                        continue
                    now = True
                    self.of.append(self._stack[-1])
                    self.text.append([])
                    self.linked.append(0)
                self.text[-1].append(m[4])
                if links:
                    self.linked[-1] += len(m[4])
                continue
            if m[2] is None:
                continue
            tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
            if tag in _INLINE:
                if tag == "a":
                    links = 0 if closing else 1
                if closing:
                    if self.tag[self._stack[-1]] == tag:
                        self._close(len(self._stack) - 1)
                        now = False
                elif attributes:
                    aside, mark = _role(tag, attributes, False)
                    if aside or mark in _WEIGHT:
                        self._open(tag, f"{tag}!{mark}", aside, mark)
                        now = False
                continue
            if tag == "br":
                if now:
                    self.text[-1].append(" ")
                continue
            now = False
            if tag in _VOID:
                continue
            if closing:
                if at := self._last((tag,)):
                    self._close(at)
                    links = 0 if tag != "p" else links
                continue
            if tag in _RAW:
                if not (attributes.rstrip().endswith("/") and tag in ("svg", "math")):
                    stop = _RAW_END[tag].search(page, pos)
                    close = page.find(">", stop.end() - 1) if stop else -1
                    pos = close + 1 if close >= 0 else end
                continue
            if tag in _CLOSES_P and (at := self._last(("p",))):
                self._close(at)
            if (ends := _CLOSES.get(tag)) and (at := self._last(ends)) > self._last(_SCOPES - ends):
                self._close(min(x for t in ends if (places := self._places.get(t)) and (x := places[-1]) > self._last(_SCOPES - ends)))
            if tag == "body":
                self._close(1)
            aside, mark = _role(tag, attributes, self.in_article[self._stack[-1]])
            name = re.search(r"class\s*=\s*[\"']?([\w-]+)", attributes) if attributes else None
            self._open(tag, f"{tag}.{name[1] if name else ''}!{mark if mark in _WEIGHT else 0}", aside, mark)

    def sums(self, of: list[int], values: list[float]) -> list[float]:
        """The values of things in elements, summed over each element's subtree."""
        out = [0.0] * len(self.tag)
        for e, v in zip(of, values):
            out[e] += v
        for e in range(len(out) - 1, 0, -1):
            out[self.parent[e]] += out[e]
        return out

    def weights(self, of: list[int], size: list[int]) -> list[float]:
        """The weight of each element's text by the names on it and around it.

        A name counts for nothing where the element holds a main element; or the page's largest
        marked article, if that has as much text as all that stands in no named element; or,
        where just a part of the name tells, most of the page's text, with no marked article
        elsewhere.
        """
        within, marked = self.sums(of, size), self.sums(of, [n * self.in_article[e] for e, n in zip(of, size)])
        last, main = list(range(len(self.tag))), [m == _MAIN_MARK and w > 0 for m, w in zip(self.mark, within)]
        inner = [False] * len(self.tag)  # whether a main element is further in
        for e in range(len(last) - 1, 0, -1):
            up = self.parent[e]
            last[up] = max(last[up], last[e])
            inner[up] = inner[up] or inner[e] or main[e]
        articles = [e for e, m in enumerate(self.mark) if m == _ARTICLE_MARK and within[e]]
        largest = max(articles, key=lambda e: (within[e], -e), default=-1)
        named = [False] * len(self.tag)
        for e in range(1, len(named)):
            named[e] = named[self.parent[e]] or self.mark[e] in _WEIGHT
        free = sum(n for e, n in zip(of, size) if not named[e])
        out = [1.0] * len(self.tag)
        for e in range(1, len(out)):
            out[e] = out[self.parent[e]]
            if self.mark[e] in _WEIGHT:
                wraps = inner[e] or e < largest <= last[e] and within[largest] >= free
                wraps = wraps or self.mark[e] == _PART_MARK and 2 * within[e] > within[0] and marked[0] == marked[e]
                out[e] = out[e] if wraps else min(out[e], _WEIGHT[self.mark[e]])
        return out


def smoothed(x: np.ndarray, sigma: float = SMOOTH) -> np.ndarray:
    """Gaussian smoothing along the page."""
    r = max(1, round(3 * sigma))
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(x, r, mode="edge"), w / w.sum(), mode="valid")


def content(page: Page, texts: list[str]) -> list[bool]:
    """Which of a page's text blocks are content; ``texts`` are those not marked aside, else empty."""
    blocks = [i for i, t in enumerate(texts) if t]
    if not blocks:
        return [False] * len(texts)
    element = [page.of[i] for i in blocks]
    size = np.array([len(texts[i]) for i in blocks], float)
    linked = np.minimum([page.linked[i] for i in blocks], size)
    own = size - linked
    weight = np.array(page.weights(element, own.tolist()))[element]
    of = np.unique([page.path[e] for e in element], return_inverse=True)[1]
    nodes, total = np.bincount(of), np.bincount(of, weights=size)
    marks = np.bincount(of, weights=[len(_PUNCTUATION.findall(texts[i])) for i in blocks])
    link_share = np.bincount(of, weights=linked) / total
    plain = np.sqrt(total / nodes * (1 + marks / nodes))
    fused = (plain * (1 - link_share))[of] * weight
    score = (np.bincount(of, weights=smoothed(fused)) / nodes)[of]
    mean = (score * size).sum() / size.sum()

    # The container: the innermost element with most of the text of paths of a good ratio.
    heading = [page.tag[e] in _HEADINGS for e in element]
    first = {page.parent[e] for e in element if page.tag[e] == "h1"}
    better = np.array([page.in_article[e] or bool(first & {e, page.parent[e]}) for e in element])
    mass = page.sums(element, (own * weight * (score >= SHARE * mean) * np.where(better, MARKED, 1.0)).tolist())
    heaviest = [0] * len(page.tag)
    for e in range(len(heaviest) - 1, 0, -1):
        if mass[e] >= MOST * mass[0]:
            heaviest[page.parent[e]] = e
    container = e = 0
    while mass[0] and heaviest[e] and page.mark[e] not in (_ARTICLE_MARK, _MAIN_MARK):
        e = heaviest[e]
        container = e if page.tag[e] in _CONTAINERS else container
    inside = [False] * len(page.tag)
    for e in range(len(inside)):
        inside[e] = e == container or e > 0 and inside[page.parent[e]]

    within = np.array([inside[e] for e in element])
    links = link_share[of] > LINKS
    sentences = (plain * (marks >= nodes))[of] * weight >= OUTSIDE * mean  # not a list of links
    stays = np.where(weight < 1, fused >= INSIDE * mean, True) & (~links | sentences)
    if container == 0 or page.tag[container] in ("html", "body"):  # nothing stands out: the ratio tells
        stays &= (score >= SHARE * mean) | np.array(heading) & (weight == 1)
    keep = np.where(within, stays, ~links & (np.minimum(score, fused) >= OUTSIDE * mean) & (total[of] >= PART * size[within].sum()))
    begin = int(within.argmax())
    if begin and not any(page.tag[e] in ("h1", "h2") for e, w in zip(element, within) if w):
        around = {container}
        while container > 0:
            around.add(container := page.parent[container])
        before = [k for k in range(begin) if page.tag[element[k]] in ("h1", "h2") and weight[k] > NEVER and not links[k]]
        if before and around & {page.parent[element[before[-1]]], page.parent[page.parent[element[before[-1]]]]}:
            keep[before[-1]] = True
    if not keep.any():
        keep = ~links
    out = [False] * len(texts)
    for i, k in zip(blocks, keep):
        out[i] = bool(k)
    return out


def main_text(html_text: str) -> str:
    """The content blocks' text, white space made single, joined by one space."""
    page = Page(html_text)
    texts = ["" if page.aside[e] else " ".join(html.unescape("".join(t)).split()) for e, t in zip(page.of, page.text)]
    return " ".join(t for t, ok in zip(texts, content(page, texts)) if ok)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points): a row for each input row, from its whole html.

    Null and empty html give the empty text; html that isn't UTF-8 text can't occur in a string
    column. Null ids and urls stay. Repeated rows have equal texts. Other columns are not read.
    Very long and very deep pages take time and memory in proportion to their length.
    """

    def make():
        def one(page_id, url, page):
            text = main_text(page.decode())
            return page_id, None if url is None else url.decode(), text, len(text)

        return one

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html")), make, "page_id long, url string, text string, n_chars long")
