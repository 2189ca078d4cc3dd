"""The stages in turn, each against its operator on its own input."""

import re

import corpus_pipeline
from corpusmill.llm import shared
from tests.llm.test_near_copies import plain_kept
from tests.llm.test_operators import plain_best, plain_hits, plain_targets


def test_stages(spark, small, tmp_path):
    docs, kept = spark.read.parquet(f"{small}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = docs.toPandas()
        if name != "sharding":
            assert docs.columns == before.columns
    good, near, clean, mixed, placed = (kept[n] for n, _ in corpus_pipeline.STAGES)
    assert sorted(near.doc_id) == plain_kept(good.doc_id.tolist(), good.text.tolist()) and near.doc_id.is_unique
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    assert set(clean.doc_id) == {d for d, t in zip(near.doc_id, near.text) if not plain_hits(t, items)[-1]}
    words = lambda f: f.assign(n=[len(re.findall(shared.WORD, t)) for t in f.text]).groupby("source").n
    want = plain_targets(words(clean).sum().to_dict())
    assert words(mixed).sum().to_dict() == {s: n for s, g in words(clean) if (n := plain_best(g.tolist(), want[s]))} and mixed.doc_id.value_counts().max() <= 2
    assert sorted(placed.doc_id) == sorted(mixed.doc_id) and placed.groupby("shard").slot.max().add(1).sum() == len(mixed)
    assert corpus_pipeline.run(spark, small).count() == len(placed)


def test_stages_on_odd_rows(spark, small, tmp_path):
    """Nulls in every column, repeats, a long text, clashing names, and no rows at all, through every stage."""
    rows = [
        (1, "One two three four five six seven.", "en", "a", 1), (1, "One two three four five six seven.", "en", "a", 1), (1, "another text with the same id as above", "en", "b", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (None, "text without any id at all here", "en", "b", 1),
        (None, None, "en", "c", 1), (4, " \n\t\n ", "en", "c", 1), (5, "word " * 50_000, "en", "a", 1), (6, "naïve café’s 日本語 ﬁ 12½\r\n end of the line for now", "fr", "d", 1),
    ]
    shape = "doc_id long, text string, lang string, source string, n_chars long, `row` int, `key` string, `rank` int, `s` int, `th` string"
    odd = spark.createDataFrame([(*r, 5, "k", 9, 1, "x") for r in rows], shape)
    for label, start in (("odd", odd), ("none", odd.limit(0))):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, small).write.parquet(f"{tmp_path}/{label}{k}")
            after = spark.read.parquet(f"{tmp_path}/{label}{k}")
            if name in ("quality_classifier", "simhash_near_dedup", "benchmark_decontamination"):
                assert after.columns == start.columns and after.exceptAll(docs).count() == 0
            if name == "simhash_near_dedup":
                assert sorted((r.doc_id is not None, r.doc_id, r.text or "") for r in after.collect()) == sorted({(r.doc_id is not None, r.doc_id, r.text or "") for r in after.collect()})
            docs = after
        assert docs.count() == 0 or label == "odd"
        assert {"doc_id", "shard", "slot"} <= set(docs.columns)
