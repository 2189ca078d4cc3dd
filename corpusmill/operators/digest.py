"""What a run measured, for each repository: counts, technology stack and the short text that goes into a prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import findings as found

# Packages that name a framework, and the labels of the measurements in a digest.
FRAMEWORKS = ["react", "next", "vue", "svelte", "angular", "express", "fastify", "nest", "django", "flask", "fastapi", "starlette", "torch", "transformers", "openai", "tailwindcss", "redux", "prisma", "graphql"]
MEASURED = [
    ("total_files", "files"),
    ("total_loc", "lines"),
    ("hotspot_count", "hotspots"),
    ("total_vulnerabilities", "findings"),
    ("dismissed_findings", "dismissed by the model"),
    ("vulnerable_dependencies", "dependencies with advisories"),
]


def _top(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key as ``_r`` 1 to k; Spark limits groups before the shuffle, so a hot key sends k rows a task."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k)


def _in_order(value: Column) -> Column:
    """The values of a group of few rows, by ``_r``."""
    return F.transform(F.array_sort(F.collect_list(F.struct("_r", value.alias("v")))), lambda x: x["v"])


def _said(name: str, default: str = "None") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(default))


def run_stats(files: DataFrame, findings: DataFrame, repo: list[str]) -> DataFrame:
    """A row for each repository of ``files`` (is_source, loc): counts of files, lines and findings (severity, source, triage, reference).

    Severities are counted without dismissed findings, totals with them; a repository without findings has zeros.
    """
    live, level = found.survived(), F.upper("severity")
    counted = findings.groupBy(*repo).agg(
        F.count(F.lit(1)).alias("total_vulnerabilities"),
        *[F.count_if(live & (level == s)).alias(f"{s.lower()}_vulnerabilities") for s in ("CRITICAL", "HIGH", "MEDIUM")],
        F.count_if(F.col("source") == "static-analysis").alias("static_findings"),
        F.count_if(F.col("source") == "model-review").alias("model_findings"),
        F.count_if(~live).alias("dismissed_findings"),
        F.count_if(F.coalesce("reference", F.lit("")) != "").alias("grounded_findings"),
    )
    sizes = files.groupBy(*repo).agg(F.count(F.lit(1)).alias("total_files"), F.count_if("is_source").alias("source_files"), F.coalesce(F.sum(F.when(F.col("is_source"), F.col("loc"))), F.lit(0)).cast("bigint").alias("total_loc"))
    return sizes.join(counted, repo, "left").na.fill(0, [c for c in counted.columns if c not in repo])


def full_stats(files: DataFrame, findings: DataFrame, repo: list[str], hotspots: DataFrame, links: DataFrame, deps: DataFrame, checked: DataFrame, runs: DataFrame) -> DataFrame:
    """``run_stats`` with what other stages counted: hotspots(repo), links(repo, source, target), deps(repo, file_path, name),
    checked(repo, status, query, reason: of ``review.verify``) and runs(repo, head_sha, elapsed, analyzed_at?). What is
    missing is 0. ``languages`` counts source files, where files have a language.
    """
    n = F.count(F.lit(1))
    ran = F.col("query").isNotNull() & ~F.coalesce(F.endswith("reason", F.lit("search failed")), F.lit(False))
    sides = [
        hotspots.groupBy(*repo).agg(n.alias("hotspot_count")), links.select(*repo, "source", "target").filter("source <> target").distinct().groupBy(*repo).agg(n.alias("graph_links")),
        deps.groupBy(*repo).agg(F.count_distinct("file_path").alias("dependency_manifests"), n.alias("dependencies")),
        checked.groupBy(*repo).agg(F.count_if(F.col("status") == "vulnerable").alias("vulnerable_dependencies"), F.count_if(F.col("status") == "outdated").alias("outdated_dependencies"), F.count_if(ran).alias("research_queries")),
    ]
    out = run_stats(files, findings, repo)
    for side in sides:
        out = out.join(side, repo, "left").na.fill(0, [c for c in side.columns if c not in repo])
    if "language" in files.columns:
        counts = files.filter("is_source").groupBy(*repo, F.coalesce("language", F.lit("unknown")).alias("language")).agg(n.alias("files"))
        out = out.join(counts.groupBy(*repo).agg(F.map_from_entries(F.collect_list(F.struct("language", "files"))).alias("languages")), repo, "left")
    at = ["analyzed_at"] if "analyzed_at" in runs.columns else []
    return out.join(runs.select(*repo, "head_sha", F.round("elapsed", 2).alias("elapsed_seconds"), *at), repo, "left")


def tech_stack(files: DataFrame, deps: DataFrame, repo: list[str]) -> DataFrame:
    """A row for each repository of ``files`` (language, ord, is_manifest, is_document): primary_languages, python_share,
    manifest_count, document_count, framework_hints and dependency_evidence out of ``deps`` (name, file_path, ord).

    The four languages with most files, the earlier seen among equals; frameworks in the order they are seen; for
    the first 40 names the first two manifests.
    """
    code = F.col("language").isNotNull() & ~F.col("language").isin("document", "text")
    counts = files.filter(code).groupBy(*repo, "language").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    shares = counts.groupBy(*repo).agg(F.round(F.sum(F.when(F.col("language").isin("python", "ipynb"), F.col("n")).otherwise(0)) / F.sum("n"), 3).alias("python_share"))
    primary = _top(counts, repo, [F.desc("n"), "first"], 4).groupBy(*repo).agg(_in_order(F.col("language")).alias("primary_languages"))
    kinds = files.groupBy(*repo).agg(F.count_if("is_manifest").alias("manifest_count"), F.count_if("is_document").alias("document_count"))
    named = deps.select(*repo, F.lower("name").alias("name"), "file_path", "ord").filter("name <> ''")
    first = named.groupBy(*repo, "name").agg(F.min(F.struct("file_path", "ord")).alias("first"))
    hints = _top(first.filter(F.col("name").isin(FRAMEWORKS)), repo, ["first", "name"], len(FRAMEWORKS)).groupBy(*repo).agg(_in_order(F.col("name")).alias("framework_hints"))
    paths = _top(named, [*repo, "name"], ["file_path", "ord"], 2).groupBy(*repo, "name").agg(_in_order(F.col("file_path")).alias("paths"))
    evidence = _top(first, repo, ["first", "name"], 40).join(paths, [*repo, "name"]).groupBy(*repo).agg(F.map_from_entries(_in_order(F.struct("name", "paths"))).alias("dependency_evidence"))
    out = kinds
    for side in (primary, shares, hints, evidence):
        out = out.join(side, repo, "left")
    nothing = F.array().cast("array<string>")
    return out.withColumns({"primary_languages": F.coalesce("primary_languages", nothing), "framework_hints": F.coalesce("framework_hints", nothing), "python_share": F.coalesce("python_share", F.lit(0.0))})


def digest(stats: DataFrame, hotspots: DataFrame, findings: DataFrame, repo: list[str]) -> DataFrame:
    """``repo`` and digest: a repository's measurements, its five first hotspots and eight first live findings (both by ``ord``).

    A measurement that is missing or null is left out, and so is a heading without rows; nothing at all gives ''.
    """
    known = [(c, label) for c, label in MEASURED if c in stats.columns]
    measured = F.array_join(F.filter(F.array(*[F.concat(F.col(c).cast("string"), F.lit(f" {label}")) for c, label in known]), F.isnotnull), ", ")
    head = stats.select(*repo, F.when(measured != "", F.concat(F.lit("Analysis measurements: "), measured)).alias("head"))
    spot = F.concat(F.lit("- "), _said("file_path"), F.lit(" (score "), _said("score"), F.lit(", complexity "), _said("complexity"), F.lit(", "), _said("commits", "0"), F.lit(" commits, "), _said("findings", "0"), F.lit(" findings)"))
    issue = F.concat(F.lit("- ["), _said("severity", "?"), F.lit("] "), _said("rule", "?"), F.lit(" at "), _said("file_path"), F.lit(":"), _said("line"), F.lit(" ("), _said("triage", "pending"), F.lit(")"))
    spots = _top(hotspots, repo, ["ord"], 5).groupBy(*repo).agg(F.array_join(F.concat(F.array(F.lit("Top ranked hotspots:")), _in_order(spot)), "\n").alias("spots"))
    issues = _top(findings.filter(found.survived()), repo, ["ord"], 8).groupBy(*repo).agg(F.array_join(F.concat(F.array(F.lit("Findings that survived triage:")), _in_order(issue)), "\n").alias("issues"))
    return head.join(spots, repo, "left").join(issues, repo, "left").select(*repo, F.concat_ws("\n", "head", "spots", "issues").alias("digest"))
