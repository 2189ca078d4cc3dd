"""Spelling variants against a plain count of words and a plain search of neighbours."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.llm import spelling
from corpusmill.llm.queries import QUERIES


def plain(rows, least_points=6, least_n=5):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    words = {w: k for w, k in n.items() if len(w) >= least_points and k >= least_n}
    letters = sorted({c for w in words for c in w})
    out, form = {}, {}
    for w, k in words.items():
        near = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        near = [x for x in near if x in words and x != w]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * k else None
        out[w] = (form[w], k, len(near), form[w] and words[form[w]])
    root = lambda w: w if form[w] is None else root(form[w])
    return {w: (f, root(w), k, near, fn) for w, (f, k, near, fn) in out.items()}


def rows_of(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_query_against_plain(spark, small, medium):
    for folder in (small, medium):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        got = QUERIES["op13_spelling_variants"](spark, folder)
        assert got.count() == len(rows_of(got)) and rows_of(got) == plain(docs)


def test_long_ways_ties_and_odd_rows(spark):
    """A way of five forms, words of equal n, letters beyond ASCII, repeated letters, nulls, repeats and clashing columns."""
    rng = random.Random(4)
    text = []
    for k, w in enumerate(["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb"]):
        text += [w] * 7 ** (k + 1)
    text += ["ÀÉÎÕÜß"] * 40 + ["ÀÉÎÕÜÿ"] * 40 + ["àéîõüß"] * 5 + ["ÀÉÎÕÜ÷x"] * 6 + ["bookkeeper"] * 6 + ["bokkeeper"] * 60 + ["bookkeper"] * 60 + ["Straße", "sTRAßE"] * 9 + ["straßen"] * 200 + ["short"] * 90
    rng.shuffle(text)
    rows = [(k % 40, " ".join(text[k * 50 : k * 50 + 50]), "w", 1) for k in range(len(text) // 50 + 1)]
    rows += [(None, "straßen 7straßen_straßen", "w", 1)] * 3 + [(5, None, None, None), (None, None, None, None), (6, "", "", 0), (7, "inin " * 40_000 + "longer " * 40_000, "x", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `word` string, `n` int").repartition(6)
    got, want = rows_of(spelling.variants(docs)), plain([r[:2] for r in rows])
    assert got == want and got["aaaaaaa"][1] == "aaabbbb"
    assert spelling.variants(docs.limit(0)).count() == 0


def test_random_words(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(1500)]
    rows = [(k, " ".join(w for w in rng.sample(words, 300) for _ in range(rng.choice((1, 1, 2, 9))))) for k in range(60)]
    assert rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))) == plain(rows)


def test_words_are_dealt_once(spark):
    """Replacements and deletions meet in one shuffle of words; a rest, place and letter tell every word again."""
    n = {"aaaaaa": 5, "aaaaaaa": 9, "aaaaaab": 9, "abaaaa": 70, "baaaaa": 70, "baaaaaa": 3, "abcdef": 8, "abcdeé": 8, "abcde": 80, "xbcdef": 1, "zzzzzz": 4}
    words = spark.createDataFrame(list(n.items()), "word string, n long")
    met = spelling.meetings(words)
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    less = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    near = lambda a, b: a in less(b) or b in less(a) or (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)
    want = {w: [x for x in n if x != w and near(w, x)] for w in n}
    got = {r.word: (r.near, tuple(r.best)) for r in met.groupBy("word").agg(F.sum("near").alias("near"), F.min("best").alias("best")).collect()}
    assert got == {w: (len(xs), min((-n[x], x) for x in xs)) for w, xs in want.items() if xs} and "zzzzzz" not in got
