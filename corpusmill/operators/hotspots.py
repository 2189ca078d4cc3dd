"""Ranked files: normalised signals, a weighted score, reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of the signals, and the least score of a file that is shown.
WEIGHTS = {"complexity": 0.28, "churn": 0.24, "fan_in": 0.20, "size": 0.10, "findings": 0.18}
LEAST = 0.18


def top_functions(functions: Column, n: int = 3) -> Column:
    """The n most complex of ARRAY<STRUCT<name, complexity, lines, ...>>, longer first among equals, unnamed ones left out."""
    key = lambda f: F.struct(-f["complexity"], -f["lines"])
    order = lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)
    return F.slice(F.array_sort(F.filter(functions, lambda f: F.coalesce(f["name"], F.lit("")) != ""), order), 1, n)


def enrich(files: DataFrame, degrees: DataFrame, churned: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """files with fan_in, fan_out, commits, total_changes, finding_count; what is missing is 0. The right sides are one row a file."""
    counts = findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("finding_count"))
    out = files.join(degrees, keys, "left").join(churned, keys, "left").join(counts, keys, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("fan_in", "fan_out", "commits", "total_changes", "finding_count")})


def score(files: DataFrame, repo: list[str]) -> DataFrame:
    """Adds the five signals (each over its repository's peak, 0 where the peak is), the score, and reasons."""
    raw = {"complexity": F.col("complexity"), "churn": F.col("commits") + F.col("total_changes") / 20.0, "fan_in": F.col("fan_in"), "size": F.col("loc"), "findings": F.col("finding_count")}
    out = files.withColumns({f"raw_{k}": v.cast("double") for k, v in raw.items()})
    peaks = out.groupBy(*repo).agg(*[F.max(f"raw_{k}").alias(f"peak_{k}") for k in raw])
    # peaks by aggregation, a row for each repository, which Spark broadcasts where they are few: no window over a whole corpus
    out = out.join(peaks, repo) if repo else out.crossJoin(F.broadcast(peaks))
    out = out.withColumns({f"s_{k}": F.when(F.col(f"peak_{k}") > 0, F.col(f"raw_{k}") / F.col(f"peak_{k}")).otherwise(0.0) for k in raw})
    total = sum((F.col(f"s_{k}") * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return out.withColumn("score", F.when(F.col("finding_count") > 0, F.greatest(total, F.lit(LEAST))).otherwise(total)).drop(*[f"raw_{k}" for k in raw], *[f"peak_{k}" for k in raw])


def reasons() -> Column:
    n = lambda c: F.col(c).cast("string")
    said = F.array(
        F.when(F.col("s_complexity") >= 0.6, F.concat(F.lit("complexity "), n("complexity"))),
        F.when((F.col("s_churn") >= 0.5) & (F.col("commits") > 0), F.concat(F.lit("changed in "), n("commits"), F.lit(" commits"))),
        F.when((F.col("s_fan_in") >= 0.5) & (F.col("fan_in") >= 2), F.concat(F.lit("imported by "), n("fan_in"), F.lit(" files"))),
        F.when(F.col("finding_count") > 0, F.concat(n("finding_count"), F.lit(" findings"))),
        F.when((F.col("s_size") >= 0.7) & (F.col("loc") >= 400), F.concat(n("loc"), F.lit(" lines"))),
    )
    told = F.filter(said, lambda x: x.isNotNull())
    return F.when(F.size(told) > 0, told).otherwise(F.array(F.lit("moderate complexity, connectivity and change")))


def rank(scored: DataFrame, repo: list[str], path: str = "file_path", k: int = 8) -> DataFrame:
    """The k files of highest score in each repository, ties by path, with their reasons; below 0.18 none is shown."""
    shown = scored.filter(F.col("score") >= LEAST).withColumn("reasons", reasons())
    if not repo:
        return shown.orderBy(F.desc("score"), path).limit(k)
    return shown.withColumn("place", F.row_number().over(Window.partitionBy(*repo).orderBy(F.desc("score"), path))).filter(F.col("place") <= k)
