"""The pipeline's near-duplicate stage against all pairs of shingle sets."""

import re

import corpus_pipeline
import numpy as np
from corpusmill.llm import near_copies


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_kept(ids, texts):
    """The least id of each component of Jaccard similarity 0.8 or more."""
    sets, parent = [grams(t) for t in texts], list(range(len(ids)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                parent[find(i)] = find(j)
    kept = {}
    for i, d in enumerate(ids):
        kept[find(i)] = min(d, kept.get(find(i), d))
    return sorted(kept.values())


def test_stage_keeps_one_of_near_copies_and_no_other(spark, small):
    """Edited copies on both sides of 0.8, chains among them, next to the documents themselves."""
    rng, docs = np.random.default_rng(4), spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").toPandas()
    rows = list(docs.itertuples(index=False, name=None))
    for base in range(12):
        words = [f"w{x}" for x in rng.integers(0, 5000, 150)]
        for copy in range(12):
            for at in rng.choice(150, rng.integers(0, 6), replace=False):
                words = [*words[:at], f"new{base}x{copy}x{at}", *words[at + 1 :]]
            rows.append((100_000 + base * 100 + copy, " ".join(words)))
    rows += [(200_000, None), (200_001, ""), (200_002, "one two"), (200_003, "One  two"), (200_003, "One  two")]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(5), small)
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(*zip(*rows))


def test_stage_odd(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, th long, s string")
    assert near_copies.keep_one(empty).count() == 0
    same = spark.createDataFrame([(None, "a b c", 1, "x"), (None, "a b c", 1, "x"), (None, None, 1, "y")], empty.schema)
    assert sorted(r.s for r in near_copies.keep_one(same).collect()) == ["x", "y"]


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for size in (3, 40, 400, 4000):
        both = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        a, b = np.unique(both[: size * 9 // 10 + 1]), np.unique(both[size // 10 :])
        x = np.bitwise_count((near_copies.parity(a) ^ near_copies.parity(b)).view(np.uint64)).sum()
        assert x <= len(np.setxor1d(a, b)) and near_copies.parity(a).tolist() == near_copies.parity(a[::-1]).tolist()


def test_large_group_below_the_threshold(spark):
    """Hundreds of copies that differ among themselves in more than a fifth: a few links, and as few pairs beyond them."""
    rng = np.random.default_rng(3)
    words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
    rows = []
    for k in range(300):
        own = list(words)
        for at in rng.choice(200, 3 if k % 10 else 1, replace=False):
            own[at] = f"new{k}x{at}"
        rows.append((k, " ".join(own)))
    got = near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(*zip(*rows))
