"""Source trees as rows."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

# What a scan passes over and what it collects.
SKIP = [".git", "node_modules", "__pycache__", ".next", "dist", "build", "coverage", "venv", ".venv", "vendor", "target", "site-packages", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".gradle", "out", ".idea", ".vscode"]
SOURCES = ["py", "js", "jsx", "ts", "tsx", "mjs", "cjs", "java", "go", "rs", "php", "rb", "cs", "cpp", "c", "h", "hpp", "kt", "scala", "lua", "ex", "sh"]
MANIFESTS = ["package.json", "pyproject.toml", "requirements.txt", "requirements-dev.txt", "dev-requirements.txt", "package-lock.json", "pnpm-lock.yaml", "yarn.lock", "poetry.lock", "uv.lock", "pipfile", "pipfile.lock", "go.mod", "go.sum", "cargo.toml", "cargo.lock", "gemfile", "gemfile.lock", "composer.json", "composer.lock"]
DOCUMENTS = ["readme.md", "readme", "readme.rst", "license", "license.md", "makefile", "dockerfile", "contributing.md", "architecture.md", "changelog.md"]
MOST_FILES, SOURCE_BYTES, MANIFEST_BYTES = 250, 200_000, 2_000_000


def collected(listing: DataFrame, most: int = MOST_FILES) -> DataFrame:
    """Of a listing(repo_id, file_path, length) the files that a scan takes, with is_manifest, is_document, ord and truncated.

    Names and sizes decide. Each repository's first ``most`` in walk order are kept; ``truncated`` tells that it had more.
    """
    path = F.col("file_path")
    name, ext = F.lower(X.basename(path)), X.extension(path)
    flagged = listing.withColumns({"is_manifest": name.isin(*MANIFESTS), "is_document": name.isin(*DOCUMENTS)})
    described = F.col("is_manifest") | F.col("is_document")
    wanted = flagged.filter(~F.arrays_overlap(F.split(X.dirname(path), "/"), F.array(*map(F.lit, SKIP))) & (ext.isin(*SOURCES) | described))
    wanted = wanted.filter((F.col("length") <= F.when(described, MANIFEST_BYTES).otherwise(SOURCE_BYTES)) & (F.col("is_manifest") | ~X.is_generated(path)))
    placed = wanted.withColumn("ord", F.row_number().over(Window.partitionBy("repo_id").orderBy(X.walk_key(path))))
    kept = placed.filter(F.col("ord") <= most + 1)  # one more tells that there were more
    return kept.withColumn("truncated", F.max("ord").over(Window.partitionBy("repo_id")) > most).filter(F.col("ord") <= most)


def scan_all(spark: SparkSession, roots: dict[str, str], most: int = MOST_FILES) -> DataFrame:
    """repo_id, file_path, language, content, is_manifest, is_document, ord, truncated of repositories' folders by repo_id.

    The listing's filters come before any content is read: only collected files are opened.
    """
    tops = {("file:" + os.path.realpath(t) if "://" not in t else t).rstrip("/"): r for r, t in roots.items()}
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(roots.values())).withColumn("uri", F.regexp_replace("path", "^file:/+", "file:/"))
    depths = sorted({t.count("/") for t in tops}, reverse=True)
    for depth in depths:  # a small join for each depth of folders; of nested ones the deepest counts
        here = spark.createDataFrame([(t, r, len(t) + 2) for t, r in tops.items() if t.count("/") == depth], f"_top string, _id{depth} string, _from{depth} int")
        listed = listed.join(here, F.substring_index("uri", "/", depth + 1) == F.col("_top"), "left").drop("_top")
    first = lambda name: F.coalesce(*[F.col(f"{name}{d}") for d in depths])
    listed = listed.withColumn("repo_id", first("_id")).withColumn("file_path", F.substring(F.col("uri"), first("_from"), F.lit(1 << 20)))
    chosen = collected(listed.select("repo_id", "file_path", "length"), most).drop("length")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("\ufffd"), F.lit(""))
    return listed.select("repo_id", "file_path", "content").join(chosen, ["repo_id", "file_path"]).select(
        "repo_id", "file_path", F.when(F.col("is_document"), "document").otherwise(X.language(F.col("file_path"))).alias("language"), X.clean_lines(text).alias("content"), "is_manifest", "is_document", "ord", "truncated"
    )


def scan(spark: SparkSession, root: str, most: int = MOST_FILES) -> DataFrame:
    """``scan_all`` of one folder, without its id."""
    return scan_all(spark, {"": root}, most).drop("repo_id")


def listing(spark: SparkSession, root: str) -> DataFrame:
    """repo_id (blank), file_path, length of every file below a folder; nothing is opened."""
    top = ("file:" + os.path.realpath(root) if "://" not in root else root).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select(F.lit("").alias("repo_id"), F.substring(F.regexp_replace("path", "^file:/+", "file:/"), len(top) + 1, 1 << 20).alias("file_path"), "length")


def confined(root: str, path: str) -> str:
    """The real path of a file below the root; empty where it leaves it or is no file."""
    top, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    return full if os.path.commonpath([top, full]) == top and os.path.isfile(full) else ""


def read_one(root: str, path: str, most: int = 12_000) -> str:
    full = confined(root, path)
    if not full:
        return ""
    with open(full, encoding="utf-8", errors="ignore") as f:
        return f.read(most)
