"""Main text of pages: the cut against all labellings, the reader on odd markup, and pages whose text is known."""

import html as entities
import itertools
import random
import re
import time

import numpy as np
import pytest
from corpusmill.llm import extraction, mincut
from corpusmill.llm.html_blocks import blocks
from corpusmill.llm.queries import QUERIES


def test_cut_against_every_labelling():
    rng = random.Random(1)
    for turn in range(400):
        n = rng.randint(1, 9)
        source, sink = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 6)) for _ in range(rng.randint(0, 3 * n))]
        cost = lambda s: sum(b if x else a for x, a, b in zip(s, source, sink)) + sum(c for i, j, c in edges if s[i] != s[j])  # noqa: B023, E731
        every = list(itertools.product([False, True], repeat=n))
        best = min(map(cost, every))
        least = min(sum(s) for s in every if cost(s) == best)
        got = mincut.label(source, sink, edges)
        assert cost(got) == best and sum(got) == least, turn


def test_cut_of_long_chains():
    rng = random.Random(2)
    n = 60_000
    source, sink = [rng.randint(0, 40) for _ in range(n)], [rng.randint(0, 40) for _ in range(n)]
    edges = [(i, i + 1, rng.randint(20, 60)) for i in range(n - 1)]
    began = time.time()
    got = mincut.label(source, sink, edges)
    assert time.time() - began < 60
    best = [0, 0]  # costs of the chain so far that ends with False, with True
    for i in range(n):
        c = edges[i - 1][2] if i else 0
        best = [min(best[0], best[1] + c) + source[i], min(best[1], best[0] + c) + sink[i]]
    assert sum(b if x else a for x, a, b in zip(got, source, sink)) + sum(c for i, j, c in edges if got[i] != got[j]) == min(best)


@pytest.mark.parametrize(
    "page, want",
    [
        (None, []), ("", []), ("no markup &amp; more", ["no markup & more"]), ("<p>a<br>b  c\n d&nbsp;e</p>f", ["a b c d e", "f"]), ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
        ("<script>var t='</p>';</script>a<style>b", ["a"]), ("a<!-- <p>x</p> -->b<!-- rest", ["ab"]), ("1 < 2 &lt; 3 &am &amp", ["1 < 2 < 3 &am &"]), ("<b>bo</b>ld, <i>it</i>alic", ["bold, italic"]),
        ('<p title="a > b">c</p><p data-x=\'d > e\'>f</p>', ["c", "f"]), ("<p don't>g</p>", ["g"]), ("<ul><li>a<li>b<ul><li>c</ul></ul>", ["a", "b", "c"]), ("<title>t</title><select><option>x</select>y", ["y"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]), ("<p>cut <a href='x", ["cut"]), ("</p></b>x</i>", ["x"]), ("<DIV>A</DIV><Script>B</SCRIPT >c", ["A", "c"]), ("<svg><text>s</text></svg>&#65;&#x42;&euro;", ["AB€"]),
    ],
)
def test_blocks(page, want):
    assert [b.text for b in blocks(page)] == want


def test_reader_is_linear():
    for bad in ("<", "<!--", '<a b="', "<p", "</b>", "<li>x<div>", "<script>", "<p>a</div>", "&", "<td>", "<a href='>"):
        began = time.time()
        blocks(bad * 40_000)
        assert time.time() - began < 8, bad


def test_pages_of_other_seeds():
    weights, rng, right, whole = extraction.train(), extraction.Pages(401), [], []
    for _ in range(300):
        page, labels = rng.page()
        got = extraction.content(blocks(page), weights)
        right += [a == b for a, b in zip(got, labels, strict=True)]
        whole.append(got == labels)
    assert np.mean(right) > 0.99 and np.mean(whole) > 0.84


# Pages not made by the generator: what each is to give.
BLOG = """<html><body class="home page has-sidebar"><div id="wrap"><div class="top"><a href=/>Home</a> <a href=/a>About us</a></div>
<div class="cookie-banner"><p>We use cookies to make the site better, and by going on you agree.</p></div>
<div id="content"><div class="entry-header"><h1>The birds of spring</h1><div class="byline">By A. Writer, 3 May</div></div>
<p>The birds came back &amp; stayed, as they do each year, in great numbers.</p><p>Yes.</p><div class="ad-slot"><p>Buy a car now, it is cheap and fast.</p></div>
<p>They build nests in <a href=x>the old trees</a> near the river.</p><ul><li>Robins</li><li>Wrens</li></ul>
<div id="comments"><h3>2 comments</h3><div class="comment-text"><p>I saw one yesterday in my own garden, it was lovely to look at.</p></div></div></div>
<div class="sidebar"><h4>Archive</h4><ul><li><a href=/1>May</a></li></ul><p>A long text in the sidebar about who we are and what we do here.</p></div>
<div class="footer">Copyright 2024 The Site</div></div></body></html>"""
NEWS = """<!doctype html><body><header><a href=/>The Daily</a><nav><a href=1>World</a><a href=2>Local</a></nav></header><main><article><h1>Bridge opens</h1>
<p>The bridge opened on Monday.<p>It took three years to build, and cost more than was planned.<aside><h4>Read also</h4><a href=x>Old bridge falls</a></aside>
<p>No.</p><form action=/mail><label>Get our letter every morning by mail</label><input><button>Go</button></form><h2>The cost</h2><p>Nobody knows it yet, said the mayor.</p></article>
<section class="comments"><article><p>At last! I have waited for this since I was a child, and now it is here.</p></article></section></main>
<footer><p>&copy; The Daily, all rights reserved. Written by people who like bridges, and printed on paper.</p></footer>"""


@pytest.mark.parametrize(
    "page, want",
    [
        (BLOG, ["The birds of spring", "By A. Writer, 3 May", "The birds came back & stayed, as they do each year, in great numbers.", "Yes.", "They build nests in the old trees near the river.", "Robins", "Wrens"]),
        (NEWS, ["Bridge opens", "The bridge opened on Monday.", "It took three years to build, and cost more than was planned.", "No.", "The cost", "Nobody knows it yet, said the mayor."]),
    ],
)
def test_pages_written_by_hand(page, want):
    assert extraction.main_text(page, extraction.train()).split("\n") == want


def test_query_gives_the_articles(spark, medium):
    pages = {r.page_id: r for r in spark.read.parquet(f"{medium}/pages.parquet").collect()}
    out = QUERIES["op12_html_extraction"](spark, medium).collect()
    assert len(out) == len(pages)
    for r in out:
        inner = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id].html, re.S).group(1)
        parts = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:h1|p)>", inner))
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_odd_pages(spark):
    rows = [(1, "u", "<article><p>a</p></article>", 1, "x"), (1, "u", "<article><p>a</p></article>", 1, "x"), (None, None, None, None, None), (2, None, "", 2, "y"), (3, "v", "<article>" + "<p>One word.</p>" * 30_000 + "</article>", 3, "z")]
    out = sorted(map(tuple, extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int, text string")).collect()), key=str)
    long = "\n".join(["One word."] * 30_000)
    assert out == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (2, None, "", 0), (3, "v", long, len(long))], key=str)
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
