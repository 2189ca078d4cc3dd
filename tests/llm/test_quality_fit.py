"""What a fit of the quality classifier learns from where ids repeat."""

from corpusmill.llm import quality


def test_a_repeated_id_teaches_once(spark, monkeypatch):
    marks = [(i, i % 2) for i in range(60)]
    docs = spark.createDataFrame([(i, f"text {i} of {k}") for i, _ in marks for k in range(40 if i % 2 else 1)], "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    monkeypatch.setattr(quality, "train", lambda good, bad, rate: (good, bad))
    good, bad = quality.fit(docs, labels, rows=5)
    assert len(good) == len(bad) == 5 and all(t.endswith(b" of 0") for t in good + bad)
    assert quality.fit(docs.repartition(7), labels, rows=5) == (good, bad)
