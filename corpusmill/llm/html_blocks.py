"""Pages as blocks: a forgiving reader of HTML that gives each run of text between block elements with what surrounds it.

One pass over the page, in time linear in its length, whatever its tags: unclosed comments and raw elements take the
rest, unmatched end tags are counted out, and what an element inherits is carried on the stack.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from functools import lru_cache

# Elements that begin and end a block of text.
BLOCKS = frozenset(
    ["address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6"]
    + ["head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"]
)
# Elements without an end tag.
VOID = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"])
# Elements whose content is no markup, and elements whose content is no text of the page.
RAW = frozenset(["iframe", "noembed", "noframes", "plaintext", "script", "style", "textarea", "title", "xmp"])
DROPPED = frozenset(["audio", "button", "canvas", "datalist", "noscript", "object", "optgroup", "option", "select", "svg", "template", "video"])
# Which open element an opening one ends.
ENDS = {"li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "td": ["td", "th"], "th": ["td", "th"], "tr": ["td", "th", "tr"], "body": ["head"]}
# How far up such an element is looked for.
LISTS = frozenset(["ul", "ol", "menu", "dl", "table", "body", "html"])

# Words of class, id and role, by what they say of an element.
HINTS = {
    "ad": ["ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adbox", "adslot", "banner", "promo", "promotion", "sponsor", "sponsored", "dfp", "outbrain", "taboola"],
    "side": ["sidebar", "side", "aside", "complementary", "rail", "widget", "widgets", "secondary"],
    "menu": ["menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "toc", "tabs", "pagination", "pager", "topbar", "toolbar", "skip", "search", "tags", "taglist"],
    "notice": ["cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "dialog", "paywall", "disclaimer", "privacy"],
    "comment": ["comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "reviews", "feedback"],
    "more": ["share", "sharing", "social", "related", "recommended", "recommendations", "teaser", "teasers", "trending", "popular", "newsletter", "subscribe", "signup", "login", "follow", "next", "prev"],
    "foot": ["footer", "foot", "copyright", "contentinfo", "legal", "colophon"],
    "head": ["header", "masthead", "logo", "branding"],
    "body": ["article", "articlebody", "content", "entry", "post", "story", "text", "main", "maincontent", "prose", "body", "page"],
}
# Words after which a word of class says what the page has, not what the element is.
HAS = frozenset(["has", "with", "no", "without", "is", "show", "hide", "js"])
_WORDS = {w: name for name, words in HINTS.items() for w in words}
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|aria-hidden|hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    """text: without white space at its ends, one space inside. parent: the number of the element around its own."""

    text: str
    tag: str
    marks: frozenset
    parent: int
    depth: int
    lowest: int  # the least depth between the block before and this one
    linked: int = 0  # characters inside links
    form: int = 0  # the number of the form around it


@lru_cache(maxsize=4096)
def hints(attributes: str) -> frozenset:
    """What an element's attributes say: names of HINTS, and `hidden`."""
    found = set()
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            found.add("hidden")
        elif name in ("class", "id", "role", "itemprop"):
            for token in value.split():
                words = [w.lower() for w in _SPLIT.split(token)]
                said = {_WORDS[w] for k, w in enumerate(words) if w in _WORDS and not (k and words[k - 1] in HAS)}
                found |= said - {"head"} if "body" in said else said  # the head of an entry is part of it
    return frozenset("hint_" + h for h in found)


@lru_cache(maxsize=8192)
def inherited(marks: frozenset, tag: str, said: frozenset) -> frozenset:
    """The marks inside an element, from those around it: sections by name, hints, and headers by where they stand."""
    own = set(said)
    if tag == "article":
        marks = marks - {"form"}
        own.add(tag)
    elif tag == "main":
        marks, own = frozenset(), own | {tag}  # there is one in a page: what stands around it says nothing of it
    elif tag in ("html", "body"):
        own = set()
    elif tag == "header":
        own.add("header_of_article" if "article" in marks else "header")
    elif tag in ("nav", "footer", "aside", "form", "table", "figure", "blockquote"):
        own.add(tag)
    elif tag == "search":
        own.add("form")
    elif tag == "fieldset":
        own.add("form")
    elif tag in ("dialog", "menu"):
        own.add("hint_notice" if tag == "dialog" else "nav")
    elif tag in ("ul", "ol", "dl"):
        own.add("list")
    return marks | own


@dataclass
class _Reader:
    html: str
    blocks: list = field(default_factory=list)
    stack: list = field(default_factory=lambda: [("", 0, frozenset(), False)])  # (tag, number, marks, dropped)
    open_: dict = field(default_factory=dict)
    pieces: list = field(default_factory=list)
    linked: int = 0
    links: int = 0
    form: int = 0
    lowest: int = 0
    numbers: int = 0

    def text(self, piece: str) -> None:
        if piece and not self.stack[-1][3]:
            self.pieces.append(piece)
            if self.links:
                self.linked += len(" ".join(piece.split()))

    def flush(self) -> None:
        if not self.pieces:
            return
        words = " ".join(entities.unescape("".join(self.pieces)).split())
        self.pieces = []
        if words:
            at = next(i for i in range(len(self.stack) - 1, -1, -1) if i == 0 or self.stack[i][0] in BLOCKS)
            tag, _, marks, _ = self.stack[at]
            self.blocks.append(Block(words, tag, marks, self.stack[max(0, at - 1)][1], at, min(self.lowest, at), min(self.linked, len(words)), self.form))
            self.lowest = at
        self.linked = 0

    def pop(self) -> None:
        tag = self.stack.pop()[0]
        self.open_[tag] -= 1
        if tag == "a":
            self.links -= 1
        elif tag == "form" and not self.open_[tag]:
            self.form = 0
        if tag in BLOCKS:
            self.lowest = min(self.lowest, len(self.stack) - 1)

    def start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self.flush()
            if self.open_.get("p"):
                while self.open_.get("p"):
                    self.pop()
            if tag in ENDS and any(self.open_.get(t) for t in ENDS[tag]):
                for at in range(len(self.stack) - 1, 0, -1):
                    if self.stack[at][0] in ENDS[tag]:
                        while len(self.stack) > at:
                            self.pop()
                        if tag != "tr":
                            break
                    elif at < len(self.stack) and self.stack[at][0] in LISTS:
                        break
        elif tag == "br":
            self.pieces.append(" ")
        elif tag == "a" and self.open_.get("a"):
            self.end("a")
        if tag in VOID:
            return
        _, _, marks, dropped = self.stack[-1]
        said = hints(attributes) if len(attributes) > 4 and tag != "a" else frozenset()
        self.numbers += 1
        self.stack.append((tag, self.numbers, inherited(marks, tag, said) if said or tag in BLOCKS else marks, dropped or tag in DROPPED))
        self.open_[tag] = self.open_.get(tag, 0) + 1
        self.links += tag == "a"
        if tag == "form" and not self.form:
            self.form = self.numbers

    def end(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        elif tag == "br":
            self.pieces.append(" ")
        if not self.open_.get(tag):
            return
        wall = tag not in BLOCKS
        while True:
            top = self.stack[-1][0]
            if wall and top in BLOCKS:
                return  # an inline end tag does not end the block around it
            self.pop()
            if top == tag:
                return


def _tag_end(html: str, at: int, closers: dict) -> int:
    """Where the tag that begins at ``at`` ends; a `>` in a quoted value does not count. -1 where it never does."""
    end = html.find(">", at)
    look = at
    while end >= 0:
        quotes = [q for q in (html.find('"', look, end), html.find("'", look, end)) if q >= 0]
        if not quotes:
            return end
        q = min(quotes)
        if html[look:q].rstrip()[-1:] != "=":
            look = q + 1
            continue
        mark = html[q]
        close = html.find(mark, q + 1) if q < closers.get(mark, len(html)) else -1
        if close < 0:
            closers[mark] = min(closers.get(mark, len(html)), q)
            return end
        look = close + 1
        if look > end:
            end = html.find(">", look)
    return -1


def blocks(html: str) -> list[Block]:
    """The blocks of a page in its order: character references decoded, white space as one space, empty ones left out.

    Scripts, styles, titles, controls and comments give no text. A null or empty page has none.
    """
    reader, at, closers = _Reader(html or ""), 0, {}
    html, size = reader.html, len(reader.html)
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            reader.text(html[at:])
            break
        if lt > at:
            reader.text(html[at:lt])
        after = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            end = html.find("-->", lt + 2)
            at = size if end < 0 else end + 3
        elif after in ("!", "?") and after:
            end = html.find(">", lt)
            at = size if end < 0 else end + 1
        elif after.isalpha() and after.isascii() or (after == "/" and html[lt + 2 : lt + 3].isalpha() and html[lt + 2 : lt + 3].isascii()):
            name = _NAME.match(html, lt + 1 + (after == "/"))
            end = _tag_end(html, name.end(), closers)
            if end < 0:
                break  # a tag that is cut off ends the page
            tag, at = name.group().lower(), end + 1
            if after == "/":
                reader.end(tag)
            else:
                attributes = html[name.end() : end]
                if tag in RAW:
                    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                    stop = -1 if close is None else html.find(">", close.end())
                    at = size if stop < 0 else stop + 1
                else:
                    reader.start(tag, attributes)
                    if attributes.endswith("/") and tag == "svg":
                        reader.end(tag)
        else:
            reader.text("<" if after != "/" else "")
            at = lt + 1 if after != "/" else (size if html.find(">", lt) < 0 else html.find(">", lt) + 1)
    reader.flush()
    return _without_page_forms(reader.blocks)


def _without_page_forms(page: list[Block]) -> list[Block]:
    """A form around the first heading and more than half of a page's text is the page, no form of it: its blocks lose that mark."""
    sizes: dict[int, int] = {}
    for b in page:
        sizes[b.form] = sizes.get(b.form, 0) + len(b.text)
    headed = {b.form for b in page if b.tag == "h1"}
    whole = {f for f, n in sizes.items() if f in headed and f and 2 * n > sum(sizes.values())}
    for b in page:
        if b.form in whole:
            b.marks = b.marks - {"form"}
    return page
