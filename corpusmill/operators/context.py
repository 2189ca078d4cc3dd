"""The text that goes into a prompt: files worth reading, their neighbours under a budget, the repository in general."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import graph

# What a listing for context takes and passes over, documents by priority, names of entry points, and limits in characters.
EXTENSIONS = ["py", "js", "jsx", "ts", "tsx", "mjs", "cjs", "json", "md", "txt", "toml", "yml", "yaml", "css", "html", "env"]
SKIP = [".git", "node_modules", "__pycache__", ".next", "dist", "build", "coverage", "venv", ".venv"]
NAMES = ["readme", "readme.md", "license", "makefile", "dockerfile"]
PRIORITY = {"readme.md": 100, "readme": 100, "readme.rst": 99, "architecture.md": 90, "contributing.md": 80, "license": 70, "license.md": 70, "makefile": 60, "dockerfile": 60, "changelog.md": 40}
ENTRY_POINTS = ["main.py", "__main__.py", "app.py", "cli.py", "server.py", "run.py", "wsgi.py", "asgi.py", "manage.py", "index.ts", "index.tsx", "index.js", "index.jsx", "main.ts", "main.tsx", "main.js", "main.go", "main.rs"]
MOST_BYTES, READ, TARGET, RELATED = 200_000, 12_000, 6_000, 4_000
BUDGET = {True: 32_000, False: 18_000}
MOST_TARGETS = {True: 12, False: 6}


def is_source() -> Column:
    """Neither a document nor a manifest."""
    return ~F.coalesce("is_document", F.lit(False)) & ~F.coalesce("is_manifest", F.lit(False))


def is_broad(query: str) -> bool:
    """``exprs.is_broad_query`` of a query at hand."""
    low = query.lower()
    return any(m in low for m in X.BROAD_MARKERS) or (bool(re.search(X.QUESTION, low)) and not re.search(r"[/._-]", low))


def public_files(files: DataFrame) -> DataFrame:
    """The records without their text."""
    return files.drop("content")


def listing(paths: DataFrame) -> DataFrame:
    """Of paths(repo_id?, file_path, length) those worth reading for context: by ending or name, .env files too, none generated or large."""
    path, name = F.col("file_path"), X.basename(F.col("file_path"))
    inside = F.arrays_overlap(F.split(X.dirname(path), "/"), F.array(*map(F.lit, SKIP)))
    wanted = X.extension(path).isin(*EXTENSIONS) | F.lower(name).isin(*NAMES) | F.startswith(name, F.lit(".env"))
    return paths.filter(~inside & wanted & (F.col("length") <= MOST_BYTES) & ~X.is_generated(path))


def with_disk(files: DataFrame, disk: DataFrame) -> DataFrame:
    """files(repo_id?, file_path, language, complexity, ...) and, without facts, those of ``disk`` that they lack."""
    keys = [c for c in ("repo_id", "file_path") if c in files.columns]
    extra = listing(disk).join(files.select(*keys), keys, "left_anti").select(*keys, X.context_language(F.col("file_path")).alias("language"), F.lit(0).alias("complexity"))
    return files.unionByName(extra, allowMissingColumns=True)


def documents(files: DataFrame, repo: list[str]) -> DataFrame:
    """Readme, licence and build files: repo, file_path, priority, content (4,000 characters), place; by priority, then as walked (ord)."""
    score = X.lookup({k: str(v) for k, v in PRIORITY.items()}, F.lower(X.basename(F.col("file_path")))).cast("int")
    found = files.withColumn("priority", score).filter("priority is not null")
    place = F.row_number().over(Window.partitionBy(*repo).orderBy(F.desc("priority"), "ord", "file_path"))
    return found.select(*repo, "file_path", "priority", F.substring(F.coalesce("content", F.lit("")), 1, 4000).alias("content"), place.alias("place"))


def entry_points(files: DataFrame, repo: list[str], most: int = 12) -> DataFrame:
    """repo, file_path, place: files with the name of an entry point, each once, as walked (ord), the first ``most``."""
    named = files.filter(F.lower(X.basename(F.col("file_path"))).isin(*ENTRY_POINTS)).groupBy(*repo, "file_path").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(Window.partitionBy(*repo).orderBy("ord", "file_path"))
    return named.select(*repo, "file_path", place.alias("place")).filter(F.col("place") <= most)


def structural(points: DataFrame, repo: list[str]) -> DataFrame:
    """repo, file_path: what an architecture (entry_points, extension_points, risks: arrays with file_path) names, each once."""
    paths = F.concat(*[F.coalesce(F.transform(c, lambda x: x["file_path"]), F.array().cast("array<string>")) for c in ("entry_points", "extension_points", "risks")])
    return points.select(*repo, F.explode(paths).alias("file_path")).filter(F.coalesce("file_path", F.lit("")) != "").distinct()


def select(files: DataFrame, query: str, repo: list[str], named: DataFrame | None = None, most: int = 10) -> DataFrame:
    """The files to answer a query by, with ``relevance`` and ``place``, in each repository.

    By relevance, then path, each path once. A broad query takes ``most``, and the files that are structural (named:
    repo, file_path) even without relevance; another takes 6. Where nothing is relevant the first in order (ord) come.
    """
    broad = is_broad(query)
    limit = most if broad else min(most, 6)
    scored = files.withColumn("relevance", X.relevance(F.col("file_path"), X.query_terms(F.lit(query))))
    chosen = F.col("relevance") > 0
    if named is not None and broad:
        scored = scored.join(named.select(*repo, "file_path", F.lit(True).alias("_named")).distinct(), [*repo, "file_path"], "left")
        chosen = chosen | F.coalesce("_named", F.lit(False))
    scored = scored.withColumn("_chosen", chosen).drop("_named")
    order = [F.desc("_chosen"), F.when(F.col("_chosen"), -F.col("relevance")), F.when(F.col("_chosen"), F.col("file_path")), "ord"]
    once = F.row_number().over(Window.partitionBy(*repo, "file_path").orderBy("ord"))
    ranked = scored.withColumn("_once", once).filter((F.col("_once") == 1) & (F.coalesce("file_path", F.lit("")) != "")).drop("_once")
    ranked = ranked.withColumn("place", F.row_number().over(Window.partitionBy(*repo).orderBy(*order))).filter(F.col("place") <= limit)
    best = F.max("_chosen").over(Window.partitionBy(*repo))
    return ranked.withColumn("_any", best).filter(F.col("_chosen") | ~F.col("_any")).drop("_chosen", "_any")


def _gather(broad: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out, total = set(), [], 0
        pdf = pdf.sort_values(["place", "kind", "other_ord"], na_position="first")
        for _, rows in pdf.groupby("place", sort=True):
            target = rows.iloc[0]
            if target["file_path"] in used or int(target["place"]) > MOST_TARGETS[broad]:
                continue
            used.add(target["file_path"])
            text = (target["content"] or "")[:READ][:TARGET]
            total += len(text)
            out.append((len(out) + 1, "target", target["file_path"], text))
            added = 0
            for row in rows.itertuples():
                if added >= 2 or total >= BUDGET[broad]:
                    break
                if row.other is None or row.other != row.other or row.other in used or not row.other_content:
                    continue
                text = row.other_content[:READ][:RELATED]
                used.add(row.other)
                out.append((len(out) + 1, "related", row.other, text))
                total, added = total + len(text), added + 1
            if total >= BUDGET[broad]:
                break
        made = pd.DataFrame(out, columns=["place", "role", "file_path", "text"])
        for c in [c for c in pdf.columns if c == "repo_id"]:
            made.insert(0, c, pdf[c].iloc[0])
        return made

    return run


def gather(selected: DataFrame, files: DataFrame, edges: DataFrame, broad: bool) -> DataFrame:
    """repo_id, place, role, file_path, text: the selected files and up to two beside each, while the budget lasts.

    selected(repo_id, file_path, place), files(repo_id, file_path, content, ord), edges(repo_id, source, target).
    Beside a file stand those it is linked with, by path, then those of its folder in order; each file comes once.
    What is chosen depends on what came before, so a repository's few selected files are walked in one group; their
    neighbours are cut to what the walk can use before they meet.
    """
    most = MOST_TARGETS[broad] * 3
    targets = selected.select("repo_id", "file_path", "place").filter(F.col("place") <= MOST_TARGETS[broad])
    known = files.select("repo_id", F.col("file_path").alias("other"), F.substring("content", 1, READ).alias("other_content"), F.col("ord").alias("_ord"))
    pairs = edges.select("repo_id", F.col("source").alias("file_path"), F.col("target").alias("other"))
    ways = pairs.unionByName(pairs.select("repo_id", F.col("other").alias("file_path"), F.col("file_path").alias("other"))).distinct()
    linked = targets.join(ways, ["repo_id", "file_path"]).filter("file_path <> other").withColumns({"kind": F.lit(0), "_key": F.struct(F.lit(0).cast("bigint").alias("n"), F.col("other").alias("p"))})
    folder = X.dirname(F.col("file_path")).alias("dir")
    within = F.row_number().over(Window.partitionBy("repo_id", "dir").orderBy("ord", "file_path"))
    first = files.select("repo_id", "file_path", "ord", folder).withColumn("_n", within).filter(F.col("_n") <= most + 1).select("repo_id", "dir", F.col("file_path").alias("other"), F.col("ord").alias("_o"))
    beside = targets.withColumn("dir", X.dirname(F.col("file_path"))).join(first, ["repo_id", "dir"]).filter("file_path <> other").drop("dir")
    beside = beside.withColumns({"kind": F.lit(1), "_key": F.struct(F.col("_o").cast("bigint").alias("n"), F.col("other").alias("p"))}).drop("_o")
    both = linked.unionByName(beside)
    near = F.row_number().over(Window.partitionBy("repo_id", "file_path").orderBy("kind", "_key"))
    near = both.join(known.drop("_ord"), ["repo_id", "other"]).withColumn("other_ord", near).filter(F.col("other_ord") <= 2 * most).drop("_key")
    own = files.select("repo_id", "file_path", F.substring("content", 1, READ).alias("content"))
    # a target's text comes once, in a row of its own before its neighbours
    rows = targets.join(own, ["repo_id", "file_path"], "left").withColumns({"kind": F.lit(-1), "other": F.lit(None).cast("string"), "other_content": F.lit(None).cast("string"), "other_ord": F.lit(0)})
    rows = rows.unionByName(near.withColumn("content", F.lit(None).cast("string")).select(rows.columns))
    return rows.groupBy("repo_id").applyInPandas(_gather(broad), "repo_id string, place int, role string, file_path string, text string")


def sources(used: DataFrame, read: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """by, file_path, place: context files (place), then files that tools read (seq), each once; a list for each value of ``by``."""
    both = used.select(*by, "file_path", F.lit(0).alias("_k"), F.col("place").alias("_p")).unionByName(read.select(*by, "file_path", F.lit(1).alias("_k"), F.col("seq").alias("_p")))
    first = both.filter(F.coalesce("file_path", F.lit("")) != "").groupBy(*by, "file_path").agg(F.min(F.struct("_k", "_p")).alias("first"))
    return first.select(*by, "file_path", F.row_number().over(Window.partitionBy(*by).orderBy("first", "file_path")).alias("place"))


def _lines(rows: DataFrame, repo: list[str], order: list, text: Column, most: int, out: str, sep: str = "\n") -> DataFrame:
    """The texts of a repository's first ``most`` rows, joined in order."""
    top = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*repo).orderBy(*order))).filter(F.col("_r") <= most)
    return top.groupBy(*repo).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", text.alias("t")))), lambda x: x["t"]), sep).alias(out))


def general(snapshots: DataFrame, files: DataFrame, deps: DataFrame, docs: DataFrame, repo: list[str]) -> DataFrame:
    """repo, context: address, commit, size, architecture, four manifests with 40 dependencies each, five documents, twelve files.

    snapshots(repo, repo_url, head_sha, pattern, summary); files(repo, file_path, language, complexity, loc, ord);
    deps(repo, file_path, ecosystem, name, version, file_ord, ord); docs(repo, file_path, content, place). What a
    repository lacks leaves no line.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    counted = files.groupBy(*repo).agg(F.count(F.lit(1)).alias("_files"))
    shape = _lines(files, repo, ["ord"], F.concat(F.lit("- "), said("file_path"), F.lit(" ("), said("language"), F.lit(", complexity "), F.coalesce(F.col("complexity").cast("string"), F.lit("0")), F.lit(", "), F.coalesce(F.col("loc").cast("string"), F.lit("0")), F.lit(" lines)")), 12, "_shape")
    named = _lines(deps, [*repo, "file_path", "ecosystem", "file_ord"], ["ord"], F.btrim(F.concat(said("name"), said("version"))), 40, "_names", ", ")
    manifests = _lines(named, repo, ["file_ord", "file_path"], F.concat(F.lit("Dependencies from "), said("file_path"), F.lit(" ("), said("ecosystem"), F.lit("): "), F.substring("_names", 1, 2000)), 4, "_manifests")
    papers = _lines(docs, repo, ["place"], F.concat(F.lit("\nFile: "), said("file_path"), F.lit("\n"), F.substring(said("content"), 1, 3000)), 5, "_papers")
    out = snapshots
    for side in (counted, shape, manifests, papers):
        out = out.join(side, repo, "left")
    line = lambda label, c: F.when(said(c) != "", F.concat(F.lit(label), said(c)))
    return out.select(
        *repo,
        F.concat_ws(
            "\n", F.concat(F.lit("Repository URL: "), said("repo_url")), F.concat(F.lit("Commit analysed: "), F.substring(said("head_sha"), 1, 12)), F.concat(F.lit("Total files analysed: "), F.coalesce("_files", F.lit(0)).cast("string")),
            line("Architecture: ", "pattern"), line("Summary: ", "summary"), F.col("_manifests"), F.col("_papers"), F.when(F.col("_shape").isNotNull(), F.concat(F.lit("\nRepository structure:\n"), F.col("_shape"))),
        ).alias("context"),
    )


def neighbours(edges: DataFrame, files: DataFrame, cap: int = 2) -> DataFrame:
    """As ``graph.related``, for callers of this module."""
    return graph.related(edges, files, cap)
