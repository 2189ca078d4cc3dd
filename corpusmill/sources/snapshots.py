"""Results by repository and commit: written in place, probed, expired."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X


def save(df: DataFrame, root: str) -> None:
    """Replaces only the partitions (repo_id) that ``df`` holds; the committer publishes them whole."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo_id").parquet(root)


def load(spark: SparkSession, root: str, repo_id: str | None = None) -> DataFrame:
    df = spark.read.option("ignoreCorruptFiles", True).parquet(root)
    return df if repo_id is None else df.filter(F.col("repo_id") == repo_id)


def current(snapshots: DataFrame, heads: DataFrame) -> DataFrame:
    """Snapshots that a remote head confirms: the same non-empty sha, not truncated, with a clone."""
    j = snapshots.join(heads.withColumnRenamed("head_sha", "remote_sha"), "repo_url")
    return j.filter((F.col("head_sha") == F.col("remote_sha")) & (F.col("head_sha") != "") & ~F.coalesce("truncated", F.lit(False)) & (F.coalesce("repo_path", F.lit("")) != "")).drop("remote_sha")


def expired(meta: DataFrame, now, ttl_hours: int = 24, most: int = 40, keep: str = "") -> DataFrame:
    """Snapshots to remove, oldest first: past their time, or among the oldest above ``most``; never ``keep``."""
    newest = F.broadcast(meta.orderBy(F.desc("modified"), F.desc("repo_id")).limit(most).select("repo_id", F.lit(True).alias("_new")))  # ``most`` rows
    old = F.col("modified") <= F.lit(now) - F.expr(f"interval {ttl_hours} hours")
    return meta.join(newest, "repo_id", "left").filter((old | F.col("_new").isNull()) & (F.col("repo_id") != keep)).orderBy("modified", "repo_id").drop("_new")


def forget(registry: DataFrame, ids: DataFrame) -> DataFrame:
    return registry.join(ids.select("repo_id"), "repo_id", "left_anti")


def stats(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


# The parts of a public result, and what stands for one that is missing.
PUBLIC = {
    "repo_id": "", "repo_url": "", "head_sha": "", "files": "[]", "graph": "{}", "hotspots": "[]", "vulnerabilities": "[]", "security_summary": "{}", "dependency_manifests": "[]", "tech_stack": "{}",
    "ai_dependencies": '{"vulnerable": [], "outdated": []}', "dependency_research": "{}", "architecture": "{}", "churn": "{}", "llm_usage": "[]", "truncated": False, "cached": False, "stats": "{}",
}


def public(snapshot: DataFrame, columns: dict[str, object] | None = None) -> DataFrame:
    """The named columns (of ``PUBLIC``), with a default where one is missing or null."""
    columns = PUBLIC if columns is None else columns
    return snapshot.select(*[F.coalesce(F.col(c), F.lit(d)).alias(c) if c in snapshot.columns else F.lit(d).alias(c) for c, d in columns.items()])


def register(registry: DataFrame, added: DataFrame, now, ttl_hours: int = 24, most: int = 40) -> DataFrame:
    """The registry(repo_id, repo_url, modified, ...) after ``added`` came: one row an id, the later one, less what expires; what was added stays."""
    both = registry.withColumn("_new", F.lit(False)).unionByName(added.withColumn("_new", F.lit(True)))
    last = both.groupBy("repo_id").agg(F.max_by(F.struct(*registry.columns, "_new"), F.struct("_new", "modified")).alias("r")).select("r.*")
    gone = expired(last.filter(~F.col("_new")).select("repo_id", "modified").unionByName(last.filter("_new").select("repo_id", "modified")), now, ttl_hours, most)
    return last.join(gone.select("repo_id", F.lit(True).alias("_gone")), "repo_id", "left").filter(F.col("_new") | F.col("_gone").isNull()).drop("_new", "_gone")


def index(registry: DataFrame) -> DataFrame:
    """repo_url and the id of its latest snapshot."""
    return registry.groupBy("repo_url").agg(F.max_by("repo_id", F.struct("modified", "repo_id")).alias("repo_id"))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """The entries of a catalogue (a JSON array) that name a snapshot."""
    return spark.read.option("multiLine", True).json(path).filter(F.coalesce("snapshot", F.lit("")) != "")


def demo(entries: DataFrame, snapshots: DataFrame, slug: str) -> DataFrame:
    """The stored snapshot(snapshot, repo_url, head_sha, ...) of an entry(slug, label, repo_url, snapshot): its path blanked, its origin told.

    A slug that could be a path names nothing.
    """
    entry = entries.filter((F.col("slug") == slug) & X.demo_slug_ok(F.col("slug"))).limit(1).select("snapshot", F.struct("slug", F.coalesce("label", "slug").alias("label"), F.col("repo_url").alias("repo_url")).alias("demo"))
    found = snapshots.join(F.broadcast(entry), "snapshot")  # one entry
    return found.withColumn("repo_path", F.lit("")) if "repo_path" in snapshots.columns else found


def export(df: DataFrame, target: str) -> None:
    """Each snapshot as a line of JSON."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(target)
