"""Change history: parsed logs, churn by file, recent commits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def renamed(path: Column) -> Column:
    """The new name of 'a => b' and 'x/{a => b}/y'."""
    braced = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    return F.regexp_replace(F.regexp_replace(braced, r"^.* => ", ""), "//", "/")


def parse_log(logs: DataFrame) -> DataFrame:
    """repo_id, ord, sha, author, date, path from (repo_id, log): records after \\x01, fields by \\x02, then a path a line. A log may come in pieces that begin with a record; ord counts within each."""
    records = logs.select("repo_id", F.posexplode(F.split("log", "\x01")).alias("ord", "rec")).filter(F.btrim("rec") != "")
    head = F.substring_index("rec", "\n", 1)
    paths = F.filter(F.transform(F.split(F.regexp_replace("rec", r"^[^\n]*\n?", ""), "\n"), lambda p: F.btrim(p)), lambda p: p != "")
    part = lambda k: F.split_part(head, F.lit("\x02"), F.lit(k))
    return records.select("repo_id", "ord", part(1).alias("sha"), part(2).alias("author"), F.to_date(F.substring(part(3), 1, 10)).alias("date"), F.explode_outer(paths).alias("path")).withColumn("path", renamed(F.col("path")))


def parse_numstat(logs: DataFrame) -> DataFrame:
    """repo_id, path, added, removed of a --numstat log; binary files ('-') are left out."""
    line = logs.select("repo_id", F.explode(F.split("log", "\n")).alias("x"))
    part = lambda k: F.split_part("x", F.lit("\t"), F.lit(k))
    rows = line.filter(F.size(F.split("x", "\t")) >= 3).select("repo_id", renamed(part(3)).alias("path"), part(1).try_cast("bigint").alias("added"), part(2).try_cast("bigint").alias("removed"))
    return rows.filter("added is not null and removed is not null")


def recent(commits: DataFrame, keys: list[str], n: int = 120) -> DataFrame:
    """The latest n commits of each key, by date and then order in the log."""
    w = Window.partitionBy(*keys).orderBy(F.desc("date"), "ord")
    return commits.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def churn(touched: DataFrame, keys: list[str]) -> DataFrame:
    """keys, commits, authors (distinct, not blank), last_commit from rows (keys, sha, author, date)."""
    return touched.groupBy(*keys).agg(F.count(F.lit(1)).alias("commits"), F.count_distinct(F.when(F.col("author") != "", F.col("author"))).alias("authors"), F.max("date").alias("last_commit"))


def line_churn(churned: DataFrame, numstat: DataFrame, keys: list[str]) -> DataFrame:
    """Adds added, removed, total_changes; paths without lines have 0, lines of unknown paths are dropped."""
    lines = numstat.groupBy(*keys).agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    return churned.join(lines, keys, "left").withColumns({"added": zero("added"), "removed": zero("removed")}).withColumn("total_changes", F.col("added") + F.col("removed"))


def provenance(commits: DataFrame, keys: list[str]) -> DataFrame:
    return commits.groupBy(*keys).agg(F.count_distinct("sha").alias("commits_scanned"), F.max_by("sha", F.struct("date", -F.col("ord"))).alias("head")).withColumn("available", F.col("commits_scanned") > 0)
