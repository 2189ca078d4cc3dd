"""The main text of pages: a classifier's costs and the nearness of blocks, parted by a minimum cut.

Each page is a graph of its blocks. What it costs to call a block content or boilerplate comes from a logistic
regression over its element, its surroundings and its text; blocks that follow each other, and blocks of one parent,
are tied the more the nearer they stand in the tree. The cut of least cost parts content from the rest.
"""

from __future__ import annotations

import math
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from . import shared
from .html_blocks import Block, blocks
from .mincut import label

OUT = "page_id long, url string, text string, n_chars long"
#: Capacities are whole numbers: nats times this. No block's own cost is above MOST nats.
UNIT, MOST = 1000, 9.0
#: Ties of neighbours: nats for blocks of one element, less by FADE for each step of the tree between them; of siblings apart.
TIE, FADE, SIBLING = 1.6, 0.7, 0.4
#: What is left of a tie between blocks that differ in the sections and hints they lie in, lists and the like aside.
ACROSS, WITHIN = 0.25, frozenset(["table", "figure", "blockquote", "list", "header_of_article"])

# What a block can lie in, and what it can be; each is a feature.
MARKS = ["nav", "header", "header_of_article", "footer", "aside", "form", "table", "figure", "blockquote", "list", "hint_ad", "hint_side", "hint_menu", "hint_notice", "hint_comment", "hint_more", "hint_foot", "hint_head", "hint_hidden"]
TAGS = ["p", "h1", "h2", "h3", "li", "td", "pre", "div"]
MEASURES = ["in an article or main", "in a body by its name alone", "linked", "all linked", "longer than 25", "longer than 80", "longer than 200", "ends a sentence", "has a comma", "sign of copyright", "no section", "alone"]


def features(block: Block, alone: bool) -> list[float]:
    """1 and a value for each of MARKS, TAGS and MEASURES; ``alone``: the page has no article or main element."""
    size, marks, share = len(block.text), block.marks, block.linked / len(block.text)
    article = bool(marks & {"article", "main"})  # one feature: what lies in both is no surer to be content
    return [
        1.0, *[float(m in marks) for m in MARKS], *[float(block.tag == t) for t in TAGS], float(article), float("hint_body" in marks and not article), share, float(share > 0.6), float(size > 25), float(size > 80), float(size > 200),
        float(block.text[-1] in ".!?…\"'”»:;"), float("," in block.text), float("©" in block.text[:200] or "copyright" in block.text[:200].lower()), float(not marks & _SECTIONS), float(alone),
    ]


_SECTIONS = frozenset(["article", "main", "nav", "header", "footer", "aside", "form", "hint_body"])


def costs(page: list[Block], weights: tuple[float, ...]) -> list[float]:
    """The classifier's log odds of content for each block, within MOST."""
    alone = not any(b.marks & {"article", "main"} for b in page)
    z = np.array([features(b, alone) for b in page]) @ np.array(weights)
    return np.clip(z, -MOST, MOST).tolist()


def ties(page: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges: each block with the one before, and with the last one of its parent where that is another."""
    out, last = [], {}
    for i, b in enumerate(page):
        if i:
            steps = page[i - 1].depth + b.depth - 2 * b.lowest
            across = ACROSS if (page[i - 1].marks ^ b.marks) - WITHIN else 1.0
            out.append((i - 1, i, round(UNIT * TIE * FADE**steps * across)))
        before = last.get(b.parent)
        if before is not None and before != i - 1:
            out.append((before, i, round(UNIT * SIBLING)))
        last[b.parent] = i
    return out


def content(page: list[Block], weights: tuple[float, ...]) -> list[bool]:
    """Which blocks are content: the source's side of the minimum cut."""
    z = costs(page, weights) if page else []
    # -log p and -log(1 - p) of p = 1 / (1 + exp(-z))
    softplus = lambda x: max(x, 0.0) + math.log1p(math.exp(-abs(x)))
    return label([round(UNIT * softplus(x)) for x in z], [round(UNIT * softplus(-x)) for x in z], ties(page))


def main_text(html: str | None, weights: tuple[float, ...]) -> str:
    page = blocks(html or "")
    return "\n".join(b.text for b, kept in zip(page, content(page, weights), strict=True) if kept)


class Pages:
    """Pages to learn from: seeded, of many layouts, in words that mean nothing, with each block's label."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, least: int, most: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice("bdfglmnprstv") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most)))

    def prose(self, least: int = 2, most: int = 90) -> str:
        text = self.words(least, most)
        if self.rng.random() < 0.15:
            return text.replace(" ", self.rng.choice((" | ", "  ")))  # lists of words pass for prose, too
        return (text[:1].upper() + text[1:]).replace(" ", ", ", self.rng.randint(0, 3)) + ("." if self.rng.random() < 0.8 else "")

    def one(self, of: list):
        return self.rng.choice(of)

    def named(self, tags: list[str], names: list[str], bare: float = 0.3) -> tuple[str, str]:
        """An opening and an end tag; with a class or an id from names, or, if the element says it all, without."""
        tag = self.one(tags)
        plain = tag not in ("div", "section", "ul", "p") and self.rng.random() < bare
        return (f"<{tag}>" if plain else f'<{tag} {self.one(["class", "id"])}="{self.one(names)}">'), f"</{tag}>"

    def links(self, least: int, most: int) -> list[tuple[str, bool]]:
        n = self.rng.randint(least, most)
        a, b = self.one([("<a href=/x>", "</a>"), ("<a href=/x>", "</a>"), ("<a href=/x>", "</a>"), ("", ""), ("<span>", "</span>")])
        return [(f"<li>{a}{self.words(1, 3)}{b}</li>", False) for _ in range(n)]

    def within(self, tags: list[str], names: list[str], inner: list[tuple[str, bool]], bare: float = 0.3) -> list[tuple[str, bool]]:
        a, b = self.named(tags, names, bare)
        return [(a, None), *inner, (b, None)]

    def said(self, tag: str, kept: bool, least: int = 2, most: int = 60) -> tuple[str, bool]:
        return f"<{tag}>{self.prose(least, most)}</{tag}>", kept

    def boilerplate(self, kind: str) -> list[tuple[str, bool]]:
        no, r = lambda *a: self.said(*a), self.rng
        if kind == "menu":
            return self.within(["nav", "div", "ul"], ["menu", "main-nav", "navbar", "breadcrumbs"], self.links(2, 9), 0.6)
        if kind == "header":
            return self.within(["header", "div"], ["site-header", "masthead", "header"], [no("p", False, 1, 12), *self.boilerplate("menu")] if r.random() < 0.7 else [no(self.one(["h1", "div"]), False, 1, 5)], 0.6)
        if kind == "footer":
            return self.within(["footer", "div"], ["footer", "site-footer", "copyright"], [(f"<p>&copy; {self.prose(2, 20)}</p>", False), *(self.links(0, 4)), no("p", False, 2, 70)][: r.randint(1, 8)], 0.7)
        if kind == "ad":
            return self.within(["div", "aside", "section"], ["ad", "advert", "ad-slot", "banner", "sponsored", "promo"], [no("p", False, 2, 80)] if r.random() < 0.5 else [(self.prose(2, 40), False)], 0.1)
        if kind == "side":
            return self.within(["aside", "div"], ["sidebar", "side", "widget", "right-rail"], [no("h3", False, 1, 4), *(self.links(0, 6)), *[no("p", False, 3, 80) for _ in range(r.randint(0, 3))]], 0.6)
        if kind == "notice":
            return self.within(["div", "section", "dialog"], ["cookie-notice", "consent", "alert", "gdpr popup"], [no("p", False, 4, 60), ("<button>Fine</button>", None)], 0.2)
        if kind == "hidden":
            return [(f"<div {self.one(['hidden', 'style=display:none', 'aria-hidden=true'])}>", None), no("p", False, 2, 60), ("</div>", None)]
        if kind == "form":
            return [(f'<form action="/{self.one(["s", "in", "mail"])}">', None), no(self.one(["label", "p"]), False, 1, 30), ("<input name=q><button>Go</button></form>", None)]
        if kind == "more":
            cards = [x for _ in range(r.randint(1, 4)) for x in self.within([self.one(["article", "div"])], ["teaser", "card"], [(f"<h3><a href=/x>{self.prose(2, 8)}</a></h3>", False), no("p", False, 4, 40)])]
            return self.within(["section", "div"], ["related", "share", "recommended", "newsletter"], cards if r.random() < 0.6 else self.links(1, 5))
        one = lambda: self.within(["div", "article", "li"], ["comment", "comment-body", "reply"], [no("p", False, 1, 90) for _ in range(r.randint(1, 3))])
        return self.within(["section", "div"], ["comments", "comment-list", "disqus"], [no("h2", False, 1, 4), *[x for _ in range(r.randint(1, 5)) for x in one()]])

    def article(self) -> list[tuple[str, bool]]:
        r, out = self.rng, []
        head = [self.said("h1", True, 1, 12)]
        out += [("<header>", None), *head, self.said("p", True, 1, 8), ("</header>", None)] if r.random() < 0.2 else head
        for _ in range(r.randint(0, 9)):
            turn = r.random()
            if turn < 0.6:
                out.append((f"<p>{self.one(['', '<b>', '<i>'])}{self.prose(1, 140)}" + self.one(["<br>", ""]) + self.one(["</p>", "</p>", ""]), True))
            elif turn < 0.68:
                out.append(self.said(self.one(["h2", "h3"]), True, 1, 8))
            elif turn < 0.75:
                a, b = self.one([("", ""), ("", ""), ("<a href=/x>", "</a>")])
                out += [("<ul>", None), *[(f"<li>{a}{self.prose(1, 12)}{b}{self.one(['', self.words(1, 12)])}</li>", True) for _ in range(r.randint(1, 5))], ("</ul>", None)]
            elif turn < 0.8:
                out += [("<blockquote>", None), self.said("p", True, 3, 40), ("</blockquote>", None)]
            elif turn < 0.83:
                out += [("<table><tr>", None), *[self.said("td", True, 1, 6) for _ in range(4)], ("</tr></table>", None)]
            elif turn < 0.87:
                out += [("<figure>", None), self.said("figcaption", True, 2, 20), ("</figure>", None)]
            else:
                out += self.boilerplate(self.one(["ad", "more", "side", "form", "notice", "hidden"]))
        if r.random() < 0.15:
            out += [("<footer>", None), *self.links(1, 3), ("</footer>", None)]
        if r.random() < 0.1:
            out += self.boilerplate("comments")
        return out

    def page(self) -> tuple[str, list[bool]]:
        """HTML and the label of each of its blocks."""
        r = self.rng
        parts = [x for k in ("header", "menu", "ad", "notice", "form", "hidden") if r.random() < 0.45 for x in self.boilerplate(k)]
        own, turn = self.article(), r.random()
        if turn < 0.55:
            own = self.within(["article"], ["post", "entry", "story"], own, 0.6)
        elif turn < 0.8:
            own = self.within(["main", "div"], ["content", "entry-content", "article-body", "post"], own, 0.5)
        else:
            own = [("<div>", None), *own, ("</div>", None)]
        if r.random() < 0.2:
            own = self.within(["main", "div", "section"], ["content", "page", "wrap"], [*own, *self.boilerplate(self.one(["side", "more", "ad"]))], 0.5)
        parts += own + [x for k in ("comments", "more", "side", "ad", "footer", "footer") if r.random() < 0.45 for x in self.boilerplate(k)]
        body = "".join(html for html, _ in parts)
        if r.random() < 0.1:
            body = f'<form id="page">{body}</form>'
        if r.random() < 0.3:
            body = f'<div class="{self.one(["wrapper has-sidebar", "page no-ads", "site", "container"])}">{body}</div>'
        labels = [kept for _, kept in parts if kept is not None]
        return f"<html><head><title>{self.words(2, 5)}</title></head><body>{body}</body></html>", labels


@lru_cache(maxsize=2)
def train(seed: int = 5, pages: int = 600, steps: int = 300, decay: float = 1e-4) -> tuple[float, ...]:
    """Logistic regression on ``pages`` seeded pages, by Newton's method with decay (some 15,000 blocks, in 3 s on the driver)."""
    made, x, y = Pages(seed), [], []
    for _ in range(pages):
        html, labels = made.page()
        page = blocks(html)
        assert len(page) == len(labels), html
        alone = not any(b.marks & {"article", "main"} for b in page)
        x += [features(b, alone) for b in page]
        y += labels
    x, y = np.array(x), np.array(y, dtype=float)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(x) + decay * np.eye(len(w)), x.T @ (p - y) / len(x) + decay * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return tuple(round(float(v), 6) for v in w)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages`` (page_id, url, html): page_id, url, text, n_chars.

    text holds the content's blocks in page order, one a line: character references decoded, white space inside a block
    as one space. Null and empty pages, and pages without content, have an empty text; nulls elsewhere, repeated rows
    and very long pages come through as they are; other columns are left behind; no rows give none. The weights go to
    the tasks with the function; a page is read and cut by itself, without a shuffle.
    """
    shared.ship(pages.sparkSession)
    weights = train()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in shared.slices(batch, "html"):
                texts = [main_text(html, weights) for html in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = shared.columns_only(pages, "page_id", "url", "html")
    return rows.select(rows["page_id"].cast("long"), "url", "html").mapInArrow(run, OUT)
