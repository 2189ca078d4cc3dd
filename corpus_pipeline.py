"""From raw documents to shards: five stages, each written as Parquet and reread by the next.

Every stage takes any table with doc_id, text and source; other columns, whatever their names, come along unchanged in all
but the last. Nulls may stand anywhere, ids may repeat, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontam, mixing, near_copies, quality, sharding, shared


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for label 0 go.

    Null and empty texts score the share of label 1; each row is judged by its text alone, so repeats fare alike.
    """
    return quality.keep_good(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a five-word shingle similarity of 0.8 or more that of least id stays.

    Texts without words, null ones too, are alike. Among rows of one id the least text hash decides, then the least
    hash of the row; a null id comes after all others.
    """
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; texts without words hold none, nor do null items."""
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice.

    Null sources are one source, null texts have no words. Rows alike in id and text share what they are taken by
    the hash of the row.
    """
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row that is left; equal texts, null and empty ones too, share a shard."""
    return sharding.assign(docs, 8)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("source_mixing", source_mixing),
    ("sharding", shards),
]

#: A trained model, XXH64 with a seed and a knapsack fit are not SQL: tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared.new_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
