"""Main text of web pages by tag-path ratios.

A page's text blocks are gathered by their root-to-leaf tag path.  Per path,
text length and punctuation are set against the number of nodes, and both
ratios fused by their product.  Fused ratios are smoothed along the tree: a
path's own with those of the text below its parent and below that one's parent
(html and body, which hold everything, left out).  What a path's tags, names
and links say weighs the smoothed ratio: menus, asides, headers and footers
weigh nothing, names of boilerplate little, articles more; headings are smoothed
with what follows them, the paths of an article with all of it.  Paths that reach ``THRESHOLD`` of the page's mean, weighted by text, are content.

A form, or an element that only its class or id names as boilerplate, is taken
for the page's wrapper if it holds most of the text and no main heading, article
or main element stands clear of such elements; its name then weighs nothing.

Character references are decoded, white space inside a block becomes one space,
blocks follow in page order.  A null or empty page, or one without content
paths, has the empty text; a page of any nesting or with unclosed tags takes
time in proportion to its length; repeated rows give equal rows; an empty table
gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _rows, _text

#: Share of the page's mean ratio that a content path must reach.
THRESHOLD = 0.35
#: Shares of a path itself, of all text below its parent, and below that one's parent, in the smoothed ratio.
SMOOTHING = (0.3, 0.3, 0.4)
#: What multiplies a path's ratio: inside an article; in an element named as boilerplate; links alone (outside articles).
ARTICLE, NAMED, LINKS = 2.0, 0.002, 0.05
#: Share of the ratio of the path that follows a heading that the heading has at least, and of an article's mean that its paths have.
FLOOR = 0.5

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style textarea title noframes iframe xmp".split())
#: Elements whose text is never content.
SKIPPED = frozenset(
    "script style noscript template head title iframe object svg math canvas audio video map textarea select button input label form fieldset option datalist nav menu footer aside dialog noframes frameset applet embed".split()
)
#: Elements whose end tag may be missing: tag -> the open tags that it closes.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "optgroup": {"option", "optgroup"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
#: Elements that an open paragraph ends before.
ENDS_P = BLOCKS - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "body", "html", "legend", "option", "optgroup", "li", "dd", "dt"} | {"li", "dd", "dt"}
SCOPES = frozenset("table td th button article section div main aside nav header footer form body html ul ol dl blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Wrappers inside one another that are looked for.
WRAPPERS = 16
#: Words of class and id names of boilerplate.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement adsense adbox banner sponsor sponsored promo promotion promoted breadcrumb breadcrumbs comment comments commentlist disqus respond reply replies discussion cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay lightbox footer footnav colophon copyright header masthead topbar toolbar nav navbar navigation menu submenu sidebar side rail aside widget widgets related recommended recommendations share sharing social socials follow subscribe subscription newsletter signup login search searchform form pagination pager tags tagcloud skip hidden".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
PUNCTUATION = re.compile(r"[.,;:!?…、。،؟]")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?", re.S)
_OPEN = re.compile(r"<([a-zA-Z][^\s/>]*)")
_SPECIAL = re.compile("[>\"']")
_MARK = re.compile(r"""(class|id|role|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/"']|$)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_SPACE = re.compile(r"\s+")
_LOOSE = re.compile(r"</?[a-zA-Z][^<>]*>")


def _set_aside(attributes: str) -> bool:
    """Whether role or hiding marks speak of boilerplate."""
    for name, value in _MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named_boilerplate(attributes: str) -> bool:
    """Whether class or id names speak of boilerplate."""
    return any(n.lower() in ("class", "id") and any(p.lower() in BOILERPLATE for p in _PARTS.findall(v.strip("\"'"))) for n, v in _MARK.findall(attributes))


class _Ends:
    """Where tags end.  No stretch is searched twice, so all searches together are linear."""

    def __init__(self, page: str) -> None:
        self.page, self.dead = page, set()
        self.first = self.next = -1  # the last stretch found without a mark, and the mark after it

    def _mark(self, at: int) -> int:
        """The next ``>`` or quote, or the page's end."""
        if not self.first <= at <= self.next:
            m = _SPECIAL.search(self.page, at)
            self.first, self.next = at, m.start() if m else len(self.page)
        return self.next

    def after(self, at: int) -> int:
        """The place of the ``>`` that ends a tag, quoted values passed over; -1 if there is none."""
        page, seen = self.page, []
        while (k := self._mark(at)) < len(page) and k not in self.dead:
            if page[k] == ">":
                return k
            seen.append(k)
            if (at := page.find(page[k], k + 1) + 1) == 0:
                break
        self.dead.update(seen)
        return -1


class _Paths:
    """Tag paths as numbers: 0 is the root, a path's parent has a lower number."""

    def __init__(self) -> None:
        self.parent, self.tag, self.known = [0], ["html"], {}

    def below(self, parent: int, tag: str) -> int:
        if (k := self.known.get((parent, tag))) is None:
            k = self.known[parent, tag] = len(self.parent)
            self.parent.append(parent)
            self.tag.append(tag)
        return k


class _Node:
    __slots__ = ("article", "hard", "link", "path", "soft", "tag")

    def __init__(self, paths: _Paths, tag: str, parent: _Node | None, attributes: str, number: int = 0, wrappers: frozenset[int] = frozenset()) -> None:
        self.tag = tag
        self.article = bool(parent and parent.article) or tag in ("article", "main") or bool(re.search(r"role\s*=\s*[\"']?(main|article)\b|itemprop\s*=\s*[\"']?articleBody", attributes, re.I))
        marked = tag not in ("html", "body", "article", "main")
        self.hard = bool(parent and parent.hard) or tag in SKIPPED and tag != "form" or tag == "header" and not self.article or marked and _set_aside(attributes)
        #: the place of the outermost element that only its name, or being a form, speaks against; 0 if there is none
        self.soft = parent.soft if parent and parent.soft else number if number not in wrappers and (tag == "form" or marked and _named_boilerplate(attributes)) else 0
        self.link = bool(parent and parent.link) or tag == "a"
        inline = tag not in BLOCKS and tag not in SKIPPED and parent is not None and self.soft == parent.soft and self.hard == parent.hard
        self.path = 0 if parent is None else parent.path if inline else paths.below(parent.path, tag + ("!" if self.hard or self.soft else ""))


@dataclass
class _Page:
    """A page's blocks in order: path, inside an article, hard, soft, characters of links, text; and the paths."""

    blocks: list[tuple[int, bool, bool, bool, int, str]]
    paths: _Paths


def _blocks(page: str, wrappers: frozenset[int]) -> tuple[_Page, dict[int, int], bool]:
    """A page with some elements taken for wrappers; length of text by soft element (0: none), hard ones apart; whether a main heading, article or main stands clear."""
    weights: dict[int, int] = {}
    clear = False
    paths, ends = _Paths(), _Ends(page)
    found = _Page([], paths)
    stack = [_Node(paths, "html", None, "")]
    open_: Counter[str] = Counter()  # tags on the stack but its first
    held: list[str] = []
    linked = 0
    now = stack[0]

    def push(node: _Node) -> None:
        stack.append(node)
        open_[node.tag] += 1

    def cut(k: int) -> None:
        """Leaves k nodes on the stack."""
        while len(stack) > k:
            open_[stack.pop().tag] -= 1

    def take(text: str) -> None:
        nonlocal linked
        held.append(text)
        if stack[-1].link:
            linked += len(text)

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", entities.unescape("".join(held))).strip()
            held.clear()
            if text:
                found.blocks.append((now.path, now.article, now.hard, now.soft > 0, min(linked, len(text)), text))
                if not now.hard:
                    weights[now.soft] = weights.get(now.soft, 0) + len(text)
        linked = 0

    def switch(node: _Node) -> None:
        """Text that follows belongs to another path or block."""
        nonlocal now
        if node.path != now.path or node.article != now.article or node.soft != now.soft or node.hard != now.hard:
            flush()
        now = node

    pos, size = 0, len(page)
    while pos < size:
        lt = page.find("<", pos)
        if lt < 0:
            take(page[pos:])
            break
        if lt > pos:
            take(page[pos:lt])
        if m := _TOKEN.match(page, lt):
            pos = m.end()
            if not m[1]:
                continue
            tag = m[1].lower()
            if tag == "br":
                take(" ")
            elif tag == "p" and not open_["p"]:
                flush()
            elif open_[tag]:
                if tag in BLOCKS:
                    flush()
                while len(stack) > 1:
                    if tag not in BLOCKS and stack[-1].tag in SCOPES and stack[-1].tag != tag:
                        break  # an inline end tag closes nothing outside its block
                    last = stack[-1].tag
                    cut(len(stack) - 1)
                    if last == tag:
                        break
                switch(stack[-1])
            continue
        m = _OPEN.match(page, lt)
        end = ends.after(m.end()) if m else -1
        if end < 0:
            loose = _LOOSE.match(page, lt) if m else None  # a tag with an unpaired quote
            if not loose:
                take("<")
            pos = loose.end() if loose else lt + 1
            continue
        pos = end + 1
        tag, attributes = m[1].lower(), page[m.end() : end]
        if tag in VOID:
            if tag == "hr":
                flush()
            take(" " if tag == "br" else "")
            continue
        if tag == "html" or tag == "body" and open_["body"]:
            continue
        if tag in ENDS_P:
            flush()
            if open_["p"]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        cut(k)
                        break
                    if stack[k].tag in SCOPES:
                        break
        if tag in CLOSES:
            flush()
            if any(open_[t] for t in CLOSES[tag]):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in CLOSES[tag]:
                        cut(k)
                        break
                    if stack[k].tag in ("ul", "ol", "dl", "table", "select", "menu"):
                        break
        if tag in BLOCKS:
            flush()
        node = _Node(paths, tag, stack[-1], attributes, pos, wrappers)
        if attributes.rstrip().endswith("/") and tag in ("svg", "path", "math"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, pos)
            pos = close.end() if close else size
            continue
        if tag == "body" and open_["head"]:
            while stack[-1].tag != "head":
                cut(len(stack) - 1)
            cut(len(stack) - 1)
            node = _Node(paths, tag, stack[-1], attributes, pos, wrappers)
        push(node)
        switch(node)
        clear = clear or not node.hard and not node.soft and tag in ("h1", "article", "main")
    flush()
    return found, weights, clear


def blocks(page: str) -> _Page:
    """The blocks of a page."""
    wrappers: frozenset[int] = frozenset()
    while True:
        found, weights, clear = _blocks(page, wrappers)
        most = max(weights, key=weights.get, default=0)
        if clear or not most or 2 * weights[most] <= sum(weights.values()) or len(wrappers) == WRAPPERS:
            return found
        wrappers |= {most}


def _smoothed(ratio: np.ndarray, length: np.ndarray, paths: _Paths) -> np.ndarray:
    """Each path's ratio with those of the text below its parent and the one above, where these are not html or body."""
    text, sums = length.astype(np.float64), ratio * length
    for k in range(len(text) - 1, 0, -1):  # children come after their parents
        text[paths.parent[k]] += text[k]
        sums[paths.parent[k]] += sums[k]
    out = np.zeros(len(ratio))
    for k in np.flatnonzero(length).tolist():
        total, share, at, value = SMOOTHING[0], SMOOTHING[0] * ratio[k], k, 0.0
        for weight in SMOOTHING[1:]:
            at = paths.parent[at]
            if not at or paths.tag[at] == "body":
                break
            value = sums[at] / text[at]
            total, share = total + weight, share + weight * value
        out[k] = share / total
    return out


def content(page: str | None, threshold: float = THRESHOLD) -> str:
    """The main text of a page."""
    found = blocks(page or "")
    n = len(found.paths.parent)
    # length, punctuation, links and nodes by path; what never is content neither smooths others nor counts
    sums = np.zeros((n, 4))
    kind: dict[int, tuple[bool, bool]] = {}
    for path, article, hard, soft, links, text in found.blocks:
        if not hard:
            sums[path] += (len(text), len(PUNCTUATION.findall(text)), links, 1)
            kind[path] = (article or kind.get(path, (False, False))[0], soft)
    if not kind:
        return ""
    nodes = np.maximum(1, sums[:, 3])
    fused = sums[:, 0] / nodes * (1 + np.log1p(sums[:, 1] / nodes))
    weight = np.zeros(n)
    for path, (article, soft) in kind.items():
        weight[path] = (ARTICLE if article else max(LINKS, 1 - sums[path, 2] / sums[path, 0])) * (NAMED if soft else 1.0)
    value = _smoothed(fused, sums[:, 0], found.paths) * weight
    own = [path for path, (article, soft) in kind.items() if article and not soft]
    if own:
        value[own] = np.maximum(value[own], FLOOR * ARTICLE * (fused[own] * sums[own, 0]).sum() / sums[own, 0].sum())
    heavy = sums[:, 0] * weight
    limit = threshold * float((value * heavy).sum() / heavy.sum())
    heading = np.array([t.rstrip("!") in HEADINGS for t in found.paths.tag])
    after = 0
    for path, _, hard, *_ in reversed(found.blocks):
        if not hard and heading[path]:
            value[path] = max(value[path], FLOOR * value[after])
        else:
            after = 0 if hard else path
    return " ".join(text for path, _, hard, _, _, text in found.blocks if not hard and value[path] >= limit)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _text.pieces(batch.column("html")):
                part = batch.slice(a, b - a)
                texts = [content(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    raw = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return raw.mapInArrow(rows, f"page_id {_rows.id_type(pages, 'page_id')}, url string, text string, n_chars long")
