"""Keyed access to a folder of shards from outside: random, missing, repeated and null keys, and ids that span shards."""

import random

import pytest
from corpusmill.llm import shared, token_store
from corpusmill.llm.queries import table, tokenizer_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 2]


def test_lookup_by_random_keys(spark, medium, library):
    docs = table(spark, medium, "documents")
    folder = shared.new_folder(spark, "lookup")
    token_store.write_shards(docs, folder, tokenizer_path())
    texts, rng = {r.doc_id: r.text for r in docs.collect()}, random.Random(4)
    asked = [*rng.sample(sorted(texts), 150), *rng.sample(sorted(texts), 20), -5, 10**15, max(texts) + 1, None]
    out = token_store.lookup(spark.createDataFrame([(k, "x") for k in [*asked, *asked]], "doc_id long, ids string").repartition(5), folder).collect()
    assert sorted(r.doc_id for r in out) == sorted({k for k in asked if k in texts})
    whole = {r.doc_id: (r.start, r.n_tokens) for r in token_store.read_shards(spark, folder, token_store.manifest(folder)).collect()}
    for r in out:
        assert r.ids == ids_of(library, texts[r.doc_id]) and (r.start, r.n_tokens) == whole[r.doc_id]


def test_one_id_on_many_rows(spark, library):
    """Rows of one id that lie in several shards, and rows without one, are all found."""
    rows = [(7, f"text {k}") for k in range(900)] + [(k, f"other {k}") for k in range(100)] + [(None, f"none {k}") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    folder = shared.new_folder(spark, "lookup")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would else make one shard
    try:
        token_store.write_shards(docs, folder, tokenizer_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = token_store._spans(folder)
    assert sum(s["least"] is not None and s["least"] <= 7 <= s["most"] for s in spans) > 1
    out = token_store.lookup(spark.createDataFrame([(7,), (3,), (None,), (500,)], "doc_id long"), folder).collect()
    want = [(d, ids_of(library, t)) for d, t in rows if d in (7, 3, None)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.ids) for r in out), key=key) == sorted(want, key=key)


def test_shards_of_keys():
    spans = [{"least": None, "most": None, "nulls": 3}, {"least": 1, "most": 5, "nulls": 2}, {"least": 5, "most": 5, "nulls": 0}, {"least": 5, "most": 9, "nulls": 0}, {"least": 12, "most": 12, "nulls": 0}]
    assert token_store.shards_of([0, 1, 5, 7, 10, 12, 13, None], spans) == [[], [1], [1, 2, 3], [3], [], [4], [], [0, 1]]
    assert token_store.shards_of([1, None], []) == [[], []]


def test_empty_folder(spark):
    folder = shared.new_folder(spark, "lookup")
    token_store.write_shards(spark.createDataFrame([], "doc_id long, text string"), folder, tokenizer_path())
    assert token_store.lookup(spark.createDataFrame([(1,)], "doc_id long"), folder).count() == 0
