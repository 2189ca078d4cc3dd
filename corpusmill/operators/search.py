"""Search over files: lines by pattern, files by relevance under a budget, language and stack summaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def search_code(files: DataFrame, pattern: str, limit: int = 25, first_chars: int | None = 8000) -> DataFrame:
    """file_path, line, text of the first ``limit`` matching lines in path order; case aside, a broken pattern is literal text.

    By default only the head of a file is searched, which is what the lookup returns to a caller; None: all of it.
    """
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    text = X.clean_lines(F.col("content"))
    lines = files.select("file_path", F.posexplode(F.split(text if first_chars is None else F.substring(text, 1, first_chars), "\n")).alias("at", "text"))
    return lines.filter(F.col("text").rlike("(?i)" + pattern)).select("file_path", (F.col("at") + 1).alias("line"), X.snippet(F.col("text")).alias("text")).orderBy("file_path", "line").limit(limit)


def read_file(files: DataFrame, path: str, most: int = 8000) -> DataFrame:
    return files.filter(F.col("file_path") == path).select("file_path", F.substring("content", 1, most).alias("content"), (F.length("content") - F.length(F.replace("content", F.lit("\n"))) + 1).alias("lines"), (F.length("content") > most).alias("truncated"))


def select_context(files: DataFrame, query: str, limit: int = 6) -> DataFrame:
    """The most relevant files to a query, by path among equals; the first ones where none is relevant."""
    scored = files.withColumn("relevance", X.relevance(F.col("file_path"), X.query_terms(F.lit(query))))
    return scored.orderBy(F.desc("relevance"), "file_path").limit(limit)


def budgeted_context(selected: DataFrame, budget: int = 32_000) -> DataFrame:
    """Files in order of relevance while the characters before them are within the budget; over the few selected files."""
    before = Window.orderBy(F.desc("relevance"), "file_path").rowsBetween(Window.unboundedPreceding, -1)
    return selected.withColumn("before", F.coalesce(F.sum(F.length("content")).over(before), F.lit(0))).filter(F.col("before") < budget).drop("before")


def unknown_paths(disk: DataFrame, known: DataFrame) -> DataFrame:
    return disk.join(known.select("file_path"), "file_path", "left_anti")


def languages(files: DataFrame) -> DataFrame:
    """language, files, first place; most files first."""
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"), F.min("ord").alias("first")).orderBy(F.desc("files"), "first")


def model_context_score(files: DataFrame) -> DataFrame:
    """Files with a ``context_score`` above 0, the highest first; documents are left out."""
    f = F.col
    if "is_document" in files.columns:
        files = files.filter(~F.coalesce("is_document", F.lit(False)))
    score = F.when(f("is_entry"), 40).otherwise(0) + F.least(F.lit(20), 8 * f("finding_count")) + F.least(F.lit(15.0), f("complexity") / 8) + F.least(F.lit(10), f("fan_in")) + F.when(f("is_manifest"), 5).otherwise(0)
    return files.withColumn("context_score", score).filter(F.col("context_score") > 0).orderBy(F.desc("context_score"), "file_path")


def joined_deltas(deltas: DataFrame) -> DataFrame:
    """stream_id, text: pieces in the order of seq."""
    return deltas.groupBy("stream_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("text"))
