"""What a reader of results sees: counts, legends, clipped previews, framing values, tables in display order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import findings as found

# A preview's characters and lines, the number of files from which the farthest don't frame, and their share.
PREVIEW_CHARS, PREVIEW_LINES = 120_000, 4_000
FRAMED_WHOLE, FRAMED = 48, 0.98


def legend(nodes: DataFrame, repo: list[str], k: int = 5) -> DataFrame:
    """repo, language, files, place: the k languages with most files, lowered, 'other' where blank; ties by first seen (ord)."""
    name = F.lower(F.coalesce("language", F.lit("")))
    counts = nodes.groupBy(*repo, F.when(name == "", "other").otherwise(name).alias("language")).agg(F.count(F.lit(1)).alias("files"), F.min("ord").alias("first"))
    place = F.row_number().over(Window.partitionBy(*repo).orderBy(F.desc("files"), "first", "language"))
    return counts.withColumn("place", place).filter(F.col("place") <= k).drop("first")


def live_severities(findings: DataFrame, repo: list[str]) -> DataFrame:
    """repo, severity, n of the live findings, upper-cased, UNKNOWN where blank."""
    name = F.upper(F.coalesce("severity", F.lit("")))
    return findings.filter(found.survived()).groupBy(*repo, F.when(name == "", "UNKNOWN").otherwise(name).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


def overview(stats: DataFrame, repo: list[str]) -> DataFrame:
    """The cards of a run: counts that are missing are 0; ``severe`` is critical and high together."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") if c in stats.columns else F.lit(0).cast("bigint")
    return stats.select(*repo, n("total_files").alias("files"), n("graph_links").alias("edges"), n("total_vulnerabilities").alias("findings"), (n("critical_vulnerabilities") + n("high_vulnerabilities")).alias("severe"), n("hotspot_count").alias("hotspots"), n("dependencies").alias("dependencies"))


def of_severity(findings: DataFrame, severity: str = "all") -> DataFrame:
    """The findings of that severity, case aside; all of them for 'all'."""
    return findings if severity == "all" else findings.filter(F.upper(F.coalesce("severity", F.lit(""))) == severity.upper())


def severities(findings: DataFrame) -> DataFrame:
    return findings.select(F.upper(F.coalesce("severity", F.lit(""))).alias("severity")).distinct()


def _at(values: DataFrame, keys: list[str], value: str, place: Column, out: str) -> DataFrame:
    """The value at ``place`` (from 0, out of _n) of each key, by counting: distinct values are few beside rows, and no list is gathered."""
    counts = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    total = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    return counts.withColumn("_upto", upto).join(total, keys).filter(F.col("_upto") > place).groupBy(*keys).agg(F.min(value).alias(out))


def median(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, median: the value at place floor(n / 2) of the sorted ones; no mean of two."""
    return _at(values, keys, value, F.floor(F.col("_n") / 2), "median")


def reach(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, reach: the largest value; of more than 48 the one at place ceil(0.98 n) - 1."""
    return _at(values, keys, value, F.when(F.col("_n") > FRAMED_WHOLE, F.least(F.col("_n") - 1, F.ceil(F.col("_n") * FRAMED) - 1)).otherwise(F.col("_n") - 1), "reach")


def dependency_view(deps: DataFrame, repo: list[str]) -> DataFrame:
    """Each name once, as first seen (file_ord, ord), by name."""
    place = F.struct("file_ord", "ord")
    kept = [c for c in deps.columns if c not in (*repo, "name", "file_ord", "ord")]
    return deps.filter(F.coalesce("name", F.lit("")) != "").groupBy(*repo, "name").agg(F.min_by(F.struct(*kept), place).alias("x")).select(*repo, "name", "x.*").orderBy(*repo, "name")


def preview(content: Column) -> Column:
    """STRUCT(content, hidden_lines, truncated_at): the first 120,000 characters, of these the first 4,000 lines and a note."""
    cut = F.substring(F.coalesce(content, F.lit("")), 1, PREVIEW_CHARS)
    lines = F.split(cut, "\n", -1)
    hidden = F.greatest(F.lit(0), F.size(lines) - PREVIEW_LINES)
    text = F.when(hidden > 0, F.concat(F.array_join(F.slice(lines, 1, PREVIEW_LINES), "\n"), F.lit("\n… "), F.format_number(hidden, 0), F.lit(" more lines not shown"))).otherwise(cut)
    at = F.when(F.length(F.coalesce(content, F.lit(""))) > PREVIEW_CHARS, f"{PREVIEW_CHARS:,}").when(hidden > 0, f"{PREVIEW_LINES:,} lines")
    return F.struct(text.alias("content"), hidden.alias("hidden_lines"), at.alias("truncated_at"))


def usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Calls, tokens and seconds of each step and model (llm usage rows; nulls count 0)."""
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c)
    return calls.groupBy(*keys, "step", "model").agg(F.count(F.lit(1)).alias("calls"), n("prompt_tokens"), n("completion_tokens"), n("total_tokens"), F.count_if(F.col("finish_reason") == "length").alias("cut_short"))


def models(listed: DataFrame) -> DataFrame:
    """id, name (the id where blank), context_length, by id."""
    return listed.select("id", F.when(F.coalesce("name", F.lit("")) == "", F.col("id")).otherwise(F.col("name")).alias("name"), "context_length").orderBy("id")


def buckets(states: DataFrame) -> DataFrame:
    """kind, capacity, window, tracked: the buckets held for each limit."""
    return states.groupBy("kind", "capacity", "window").agg(F.count_distinct("key").alias("tracked"))


def jobs(states: DataFrame) -> DataFrame:
    """One row: running jobs, finished ones, and those of them that failed."""
    running = F.col("finished_at").isNull()
    return states.agg(F.count_if(running).alias("running"), F.count_if(~running).alias("finished"), F.count_if(~running & (F.coalesce("error", F.lit("")) != "")).alias("failed"))


def top_sources(sources: DataFrame, keys: list[str], k: int = 3) -> DataFrame:
    """The first k sources of a search (ord), their fields cut to 200, 500 and 400 characters, the score to 3 places."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return sources.withColumn("place", place).filter(F.col("place") <= k).select(*keys, "place", cut("title", 200), cut("url", 500), cut("snippet", 400), F.round(F.coalesce("score", F.lit(0.0)), 3).alias("score"))
