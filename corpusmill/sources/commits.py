"""A registry of snapshots that many writers commit to: each version is whole, and of two that would be the same one only one is.

Under the root lie ``data/commit=<id>/repo_id=<id>/`` (rows of snapshots), ``registry/<id>/`` (a row for each snapshot that a
version holds) and ``log/<version>.json`` (which registry a version is). What no log file names is not there.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import snapshots

ENTRIES = "repo_id string, repo_url string, modified timestamp, commit string"


class Conflict(RuntimeError):
    """Other writers took every version that was tried."""


class Registry:
    """Snapshots(repo_id, repo_url, ``schema``) by version.

    The root is a folder that all executors share. Its file system must refuse to rename onto a file that is there (HDFS
    does; on a local or mounted one a hard link does the same).
    """

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), f"repo_url string, {schema}"
        for folder in ("data", "registry", "log"):
            self._fs(folder).mkdirs(self._path(folder))

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _fs(self, *parts: str):
        return self._path(*parts).getFileSystem(self.spark._jsc.sc().hadoopConfiguration())

    def _remove(self, *parts: str) -> None:
        self._fs(*parts).delete(self._path(*parts), True)

    # ---- versions

    def versions(self) -> list[int]:
        """The versions that can be read, oldest first."""
        names = [s.getPath().getName() for s in self._fs("log").listStatus(self._path("log"))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The latest version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def _put(self, version: int, body: dict) -> bool:
        """Whether this call, and no other one, made the version: a file is written whole beside its name and then takes it if it is free."""
        name, own = f"{version:020d}.json", f".{uuid.uuid4().hex}"
        out = self._fs("log").create(self._path("log", own), False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        try:
            where = urlparse(self._fs("log").makeQualified(self._path("log")).toString())
            if where.scheme == "file":
                folder = unquote(where.path)
                try:
                    os.link(f"{folder}/{own}", f"{folder}/{name}")
                except FileExistsError:
                    return False
                return True
            return self._rename(self._path("log", own), self._path("log", name))
        finally:
            self._remove("log", own)

    def _rename(self, source, target) -> bool:
        jvm = self.spark._jvm
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.valueOf("NONE")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsc.sc().hadoopConfiguration())
        try:
            context.rename(source, target, options)
        except Exception as e:  # noqa: BLE001  the gateway's error holds the file system's
            if "AlreadyExists" in str(e) or self._fs("log").exists(target):
                return False
            raise
        return True

    def _body(self, version: int) -> dict:
        path = self._path("log", f"{version:020d}.json").toString()
        return json.loads(self.spark.read.text(path, wholetext=True).first().value)

    def entries(self, version: int | None = None) -> DataFrame:
        """repo_id, repo_url, modified, commit of a version's snapshots (the latest version's by default)."""
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], ENTRIES)
        return self.spark.read.schema(ENTRIES).parquet(f"{self.root}/registry/{self._body(version)['registry']}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version's snapshots, whole: what was committed since, or is being written, is not seen.

        Partitions of ``data`` are pruned by the version's entries at run time.
        """
        held = self.spark.read.schema(f"{self.schema}, commit string, repo_id string").option("basePath", f"{self.root}/data").parquet(f"{self.root}/data")
        return held.join(self.entries(version).select("commit", "repo_id"), ["commit", "repo_id"], "left_semi").drop("commit")

    # ---- commits

    def _commit(self, change: Callable[[DataFrame], DataFrame], what: str, tries: int) -> int:
        """Applies ``change`` to the latest registry until the next version is ours; only registries are written anew, never data."""
        for _ in range(tries):
            seen, mine = self.version(), uuid.uuid4().hex
            try:
                change(self.entries(seen)).select("repo_id", "repo_url", "modified", "commit").write.parquet(f"{self.root}/registry/{mine}")
                if self._put(seen + 1, {"version": seen + 1, "registry": mine, "what": what}):
                    return seen + 1
            except BaseException:
                self._remove("registry", mine)
                raise
            self._remove("registry", mine)
        raise Conflict(f"{what}: {tries} versions went to others")

    def save(self, df: DataFrame, now, ttl_hours: int = 24, most: int = 40, tries: int = 20) -> int:
        """Commits df(repo_id, repo_url, ``schema``, ...) and what expires by it as one version, which is returned.

        A snapshot that is there is replaced; one of no rows can't be told from none. Rows whose repo_id is null or empty are refused.
        Where this fails, nothing of it is left; where another commit comes between, that one's snapshots stay too.
        """
        commit = uuid.uuid4().hex
        names = self.spark.createDataFrame([], self.schema).columns
        try:
            df.select(*names, "repo_id").write.partitionBy("repo_id").parquet(f"{self.root}/data/commit={commit}")
            written = self.spark.read.schema(f"{self.schema}, repo_id string").parquet(f"{self.root}/data/commit={commit}")
            added = written.groupBy("repo_id").agg(F.max("repo_url").alias("repo_url")).select("repo_id", "repo_url", F.lit(now).cast("timestamp").alias("modified"), F.lit(commit).alias("commit"))
            if not added.filter("repo_id is null").isEmpty():
                raise ValueError("rows without a repo_id")
            return self._commit(lambda registry: snapshots.register(registry, added, now, ttl_hours, most), "save", tries)
        except BaseException:
            self._remove("data", f"commit={commit}")
            raise

    def forget(self, ids: DataFrame, tries: int = 20) -> int:
        """Commits the registry without ids(repo_id)."""
        return self._commit(lambda registry: snapshots.forget(registry, ids.select("repo_id").distinct()), "forget", tries)

    def expire(self, now, ttl_hours: int = 24, most: int = 40, keep: str = "", tries: int = 20) -> int:
        """Commits the registry without what is past its time or too many; never without ``keep``."""
        return self._commit(lambda registry: snapshots.forget(registry, snapshots.expired(registry, now, ttl_hours, most, keep)), "expire", tries)

    def sweep(self, versions: int = 10, grace_seconds: int = 86_400) -> list[str]:
        """Deletes versions older than the latest ``versions``, and folders that none left names and that are older than the grace.

        The grace must be longer than any write or reading takes. Ids of deleted folders are returned, in order.
        """
        kept = self.versions()[-versions:]
        for old in self.versions()[:-versions]:
            self._remove("log", f"{old:020d}.json")
        registries = {self._body(v)["registry"] for v in kept}
        named = set(registries)
        if registries:
            every = self.spark.read.schema(ENTRIES).parquet(*[f"{self.root}/registry/{r}" for r in sorted(registries)])
            named |= {r.commit for r in every.select("commit").distinct().collect()}  # at most one for each kept snapshot
        gone, now = [], self.spark._jvm.java.lang.System.currentTimeMillis()
        for folder, start in (("registry", ""), ("data", "commit=")):
            for status in self._fs(folder).listStatus(self._path(folder)):
                name = status.getPath().getName()
                if name.removeprefix(start) not in named and now - status.getModificationTime() >= grace_seconds * 1000:
                    self._remove(folder, name)
                    gone.append(name.removeprefix(start))
        return sorted(gone)
