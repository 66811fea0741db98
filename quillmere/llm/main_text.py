"""HTML extraction: tag-path ratios.

A page becomes blocks of text. Every block has the path of block-level tags from the root to the element
that holds it; elements that a page marks by tag, role, class or id have paths of their own. Per path, text length
and punctuation are summed over its blocks and taken as ratios to their number; ratios are smoothed over blocks in
page order, fused as a geometric mean and damped by the share of linked text. A path's fused value is the greatest of its
blocks, times the weights of what it runs through: ``NAMED`` for an article or main element, ``EXACT`` (names of nothing else), ``STRONG`` or
``WEAK`` for words of class and id that say what is no article, and ``LISTED`` for paths of lists of links. Paths whose value reaches
``PATH_SHARE`` of the page's best are content: all their blocks stay, and they choose the root of the article: the article and main elements
that hold such a block or, on pages without, the lowest element that holds all of them. Within an article or main element every other block stays as
well (lists, tables, quotes, code, short sections), unless its path runs through an element that words of class or id mark; within another root those
between the first and the last content block do, with headings right before, unless they are marked or lists of links.

Words of class and id are weights. They don't count for elements that hold an
article or main element or, on pages without one, half of the text; within an article a name with words of other meanings (``related-work``) doesn't
count either. Left out before are what is never shown or no text (scripts,
styles, templates, hidden elements, controls) and, with the same exception, what tags and roles say is no article: menus, headers
outside of articles, footers, sidebars, forms, dialogs. Reader comments go whatever they hold, articles of their own too, where anything else is left.

Character references are decoded, white space inside a block becomes one space,
blocks are trimmed and joined by one space in page order. No length is capped; a page is read in one pass and
every step is linear in its size and depth. Null or empty pages give the empty text, as do pages of
markup only; text outside any tag is a block. Repeated rows get equal results. A kept
column named like an output gives way to it.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillmere.llm.batches import append_columns

BLOCKS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody thead tfoot tr td th caption ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACES = frozenset("br wbr img hr input".split())
#: No text, or never shown.
SILENT = frozenset("head title script style noscript template button select option textarea label iframe object svg canvas".split())
#: No article, unless one is inside.
ASIDE = frozenset("nav footer aside form dialog menu search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
#: Words of class or id that say what is no article: some always, some often.
STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup modal "
    "newsletter subscribe subscription signup sharing share social related recommended recommendations sidebar navbar navigation nav "
    "breadcrumb breadcrumbs pagination pager comment comments commentlist respond disqus masthead topbar toolbar".split()
)
WEAK_WORDS = frozenset("banner notice notices notification alert overlay login aside widget widgets menu toc skip footer header reply replies form search copyright legal disclaimer".split())
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus reply replies".split())
#: Words that say nothing beside those above.
PLAIN_WORDS = frozenset("list box section area wrapper wrap container block posts post articles article items item links link left right top bottom inner outer content body bar panel group row col thread count title heading more icon icons".split())
NOISE_WORDS = STRONG_WORDS | WEAK_WORDS | COMMENT_WORDS | PLAIN_WORDS
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_SPACE = re.compile(r"\s+")
_PUNCT = re.compile("[.,;:!?¡¿。，、；：！？]")
#: Weights of paths, and the share of the page's best value that makes a path content.
NAMED, EXACT, STRONG, WEAK, LISTED = 8.0, 1 / 32, 1 / 8, 1 / 2, 1 / 4
PATH_SHARE = 0.2
#: What an open tag of the first kind closes, if met on the way to the second.
_CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
_SHUT_BY = ("table", "td", "th", "button")
PLAIN, SIDE, MUTE, TALK = 0, 1, 2, 3
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class _Page(HTMLParser):
    """Elements in page order (tag, parent, kind, words of class and id) and blocks (element, text, linked length)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.kind, self.named = [""], [-1], [PLAIN], [False]
        self.weight = [1.0]
        self.talk = [False]  # whether it or what it is in are reader comments
        self.silent = [False]  # whether it or what it is in is never shown
        self.open, self.gone = [0], set()
        self.at: dict[str, list[int]] = {}  # places in ``open`` of each tag
        self.blocks_open = [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.parts: list[str] = []
        self.linked = 0

    def _last(self, *tags):
        """Place of the innermost open element of these tags, 0 if there is none."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def _flush(self):
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((self.open[self.blocks_open[-1]], text, self.linked))
            self.parts = []
        self.linked = 0

    def _pop_to(self, k):
        while len(self.open) > k:
            e = self.open.pop()
            if e in self.gone:
                self.gone.discard(e)
            else:
                self.at[self.tag[e]].pop()
            if self.blocks_open[-1] == len(self.open):
                self.blocks_open.pop()

    def _look(self, tag, attrs):
        """Kind and weight of an element."""
        if tag in SILENT:
            return MUTE, 1.0
        kind = SIDE if tag in ASIDE or tag == "header" and not self._last("article", "main") else PLAIN
        weight, inside = 1.0, bool(self._last("article", "main"))
        if tag in ("html", "body", "main"):
            attrs = [(k, v) for k, v in attrs if k == "hidden"]
        for k, v in attrs:
            v = v or ""
            if k == "hidden" or k == "aria-hidden" and v.lower() == "true" or k == "style" and "display:none" in v.replace(" ", "").lower():
                return MUTE, 1.0
            if k == "role" and v.lower() in ROLES:
                kind = SIDE
            if k in ("class", "id"):
                for name in v.split():
                    words = {w.lower() for w in _WORDS.findall(name)}
                    only = words <= NOISE_WORDS
                    if words & COMMENT_WORDS and only:
                        kind = TALK
                    if tag != "article" and (only or not inside):
                        weight = min(weight, (EXACT if only else STRONG) if words & STRONG_WORDS else WEAK if words & WEAK_WORDS else 1.0)
        return kind, weight

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._flush()
            p = self._last("p")
            if p and tag not in ("html", "body") and p > self._last(*_SHUT_BY):
                self._pop_to(p)
        if tag in _CLOSES:
            what, until = _CLOSES[tag]
            k = self._last(*what)
            if k and k > self._last(*until):
                self._flush()
                self._pop_to(k)
        if tag in VOID:
            if tag in SPACES:
                self.parts.append(" ")
            return
        if tag == "a" and self._last("a"):
            self._pop_to(self._last("a"))
        kind, weight = self._look(tag, attrs)
        top = self.open[-1]
        if kind or weight < 1:
            self._flush()
        e = len(self.tag)
        self.tag.append(tag)
        self.parent.append(top)
        self.kind.append(kind)
        self.weight.append(weight)
        self.talk.append(self.talk[top] or kind == TALK)
        self.named.append(tag in ("article", "main") and not self.talk[e])
        self.silent.append(self.silent[top] or kind == MUTE)
        if tag in BLOCKS or kind or weight < 1:
            self.blocks_open.append(len(self.open))
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "a", "span", "i"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        k = self._last(tag)
        if not k:
            if tag == "p":
                self._flush()
            return
        e = self.open[k]
        if self.blocks_open[-1] > k and tag not in BLOCKS:
            # an inline end inside later blocks ends only itself
            self.gone.add(e)
            self.at[tag].pop()
            return
        if self.blocks_open[-1] >= k:
            self._flush()
        self._pop_to(k)

    def handle_data(self, data):
        if not self.silent[self.open[-1]]:
            self.parts.append(data)
            if self.at.get("a"):
                self.linked += len(data)


def _smooth(values: list[float]) -> list[float]:
    n = len(values)
    return [(2 * v + (values[i - 1] if i else v) + (values[i + 1] if i + 1 < n else v)) / 4 for i, v in enumerate(values)]


def _paths(page: _Page) -> tuple[list[int], list[float], list[bool], list[bool]]:
    """Each element's path, the weight of each path, whether an element is part of no article, and whether it or what it is in is marked."""
    n = len(page.tag)
    # text below each element, and whether an article or main element is it or in it
    mass = [0] * n
    for e, text, _ in page.blocks:
        mass[e] += len(text)
    holds = list(page.named)
    for e in range(n - 1, 0, -1):  # parents come before children
        mass[page.parent[e]] += mass[e]
        holds[page.parent[e]] |= holds[e]
    path, out, marked = [0] * n, [False] * n, [False] * n
    known: dict[tuple, int] = {}
    weight, inside = [1.0], [False]
    for e in range(1, n):
        up, tag = page.parent[e], page.tag[e]
        keeps = holds[e] or not holds[0] and 2 * mass[e] >= mass[0]
        out[e] = out[up] or page.kind[e] == SIDE and not keeps
        w = 1.0 if keeps else page.weight[e]
        marked[e] = marked[up] or w < 1
        if tag not in BLOCKS and w == 1.0:
            path[e] = path[up]
            continue
        key = (path[up], tag, w)
        if key not in known:
            known[key] = len(weight)
            first = page.named[e] and not inside[path[up]]
            weight.append(weight[path[up]] * w * (NAMED if first else 1.0))
            inside.append(inside[path[up]] or page.named[e])
        path[e] = known[key]
    return path, weight, out, marked


def _root(page: _Page, content: list[int]) -> tuple[list[bool], bool]:
    """Which elements are in the article's root, and whether that is an article or main element; ``content`` are the elements of content blocks."""
    n = len(page.tag)
    below = [0] * n
    for e in content:
        below[e] += 1
    for e in range(n - 1, 0, -1):
        below[page.parent[e]] += below[e]
    named = [page.named[e] and below[e] > 0 for e in range(n)]
    if not any(named):
        lowest = max(e for e in range(n) if below[e] == len(content))  # of elements one within the other the last
        named[lowest] = True
    within = list(named)
    for e in range(1, n):
        within[e] = within[e] or within[page.parent[e]]
    return within, any(page.named[e] and named[e] for e in range(n))


def extract(html: str | None) -> str:
    """The main text of a page."""
    if not html:
        return ""
    page = _Page()
    page.feed(html)
    page.close()
    page._flush()
    path, weight, out, marked = _paths(page)
    found = [(e, text, linked) for e, text, linked in page.blocks if not out[e]]
    found = [b for b in found if not page.talk[b[0]]] or found
    if not found:
        return ""
    blocks = [(path[e], text, linked) for e, text, linked in found]
    size: dict[int, list[int]] = {}
    for p, text, linked in blocks:
        s = size.setdefault(p, [0, 0, 0, 0])
        s[0] += len(text)
        s[1] += len(_PUNCT.findall(text))
        s[2] += 1
        s[3] += min(linked, len(text))
    lengths = _smooth([size[p][0] / size[p][2] for p, _, _ in blocks])
    marks = _smooth([(1 + size[p][1]) / size[p][2] for p, _, _ in blocks])
    value: dict[int, float] = {}
    for k, (p, _, _) in enumerate(blocks):
        s = size[p]
        linked = s[3] / s[0]
        fused = (lengths[k] * marks[k]) ** 0.5 * (1 - linked) * weight[p] * (LISTED if linked > 0.5 else 1)
        value[p] = max(value.get(p, 0.0), fused)
    bar = PATH_SHARE * max(value.values())
    good = [k for k, (p, _, _) in enumerate(blocks) if value[p] >= bar]
    within, named = _root(page, [found[k][0] for k in good])
    first, last = good[0], good[-1]
    while not named and first and page.tag[found[first - 1][0]] in HEADINGS:
        first -= 1

    def stays(k: int) -> bool:
        e, p = found[k][0], blocks[k][0]
        if value[p] >= bar:
            return True
        return within[e] and not marked[e] and (named or first <= k <= last and 2 * size[p][3] <= size[p][0])

    return " ".join([text for k, (_, text, _) in enumerate(blocks) if stays(k)])


def main_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Kept columns with ``text`` and ``n_chars`` (code points) of every whole page."""

    def make():
        def run(array: pa.Array):
            out = [extract(h) for h in array.to_pylist()]
            return pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())

        return run

    return append_columns(pages, html_col, make, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], keep, limit=1 << 20)
