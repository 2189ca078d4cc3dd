"""Git repositories as a data source: a partition for each, so that git runs on the executors, many repositories at once.

What is read: facts (head, depth, commits), heads of remotes without a clone, logs with the files or the lines that
commits touch. A repository that is no local folder is cloned into the task's own temporary folder, which goes with the
task. What fails is tried again, then becomes a row with an error; a job never fails for one repository.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import git

SHAPES = {
    "facts": "repo_id string, url string, head_sha string, is_shallow boolean, commits int, error string",
    "heads": "repo_id string, url string, head_sha string, error string",
    "log": "repo_id string, url string, log string, error string",
    "lines": "repo_id string, url string, log string, error string",
}


class Repository(InputPartition):
    def __init__(self, repo_id: str, url: str):
        self.repo_id, self.url = repo_id, url


class Repositories(DataSource):
    """Options: repositories (JSON: [[repo_id, folder or URL], ...]), what (a key of SHAPES), tries, depth of clones, deepen (commits to fetch besides), commits of a log, most_bytes."""

    @classmethod
    def name(cls) -> str:
        return "repositories"

    def schema(self) -> str:
        return SHAPES[self.options.get("what", "facts")]

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(dict(self.options))


class RepositoryReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.what = options.get("what", "facts")
        self.repositories = [tuple(r) for r in json.loads(options.get("repositories", "[]"))]
        self.tries, self.depth, self.deepen = (int(options.get(k, d)) for k, d in (("tries", "3"), ("depth", str(git.COMMITS)), ("deepen", "0")))
        self.commits, self.most_bytes = int(options.get("commits", str(git.COMMITS))), int(options.get("most_bytes", str(git.MOST_BYTES)))

    def partitions(self) -> list[InputPartition]:
        return [Repository(*r) for r in self.repositories]

    def read(self, partition: Repository) -> Iterator[tuple]:
        if partition is None:  # no repositories: one task without one
            return
        found, error = None, "no attempt"
        for k in range(max(1, self.tries)):
            found, error = self._attempt(partition.url)
            if found is not None or error == "too large":
                break
            time.sleep(0.1 * 2**k if k + 1 < self.tries else 0)
        empty = {"facts": ("", False, 0), "heads": ("",), "log": ("",), "lines": ("",)}[self.what]
        yield (partition.repo_id, partition.url, *(found or empty), "" if found is not None else error)

    def _attempt(self, url: str) -> tuple[tuple | None, str]:
        """(what was read, '') or (None, why not)."""
        if self.what == "heads":
            head = git.remote_head(url)
            return ((head,), "") if head else (None, "no head")
        if os.path.isdir(url):
            return self._of_folder(url)
        with tempfile.TemporaryDirectory(prefix="corpusmill-clone-") as parent:
            folder = git.clone(url, os.path.join(parent, "clone"), self.depth, self.most_bytes)
            return self._of_folder(folder) if folder else (None, "could not be cloned, or too large")

    def _of_folder(self, folder: str) -> tuple[tuple | None, str]:
        head = git.head(folder)
        if not head:
            return None, "no repository"
        if self.deepen and git.is_shallow(folder):
            git.deepen(folder, self.deepen)
        if self.what == "facts":
            return (head, git.is_shallow(folder), git.commit_count(folder)), ""
        kind = ["--numstat", "--pretty=format:"] if self.what == "lines" else ["--name-only", git.RECORD]
        return (git.run(folder, "log", f"-n{self.commits}", *kind),), ""


def read(spark: SparkSession, repositories: list[tuple[str, str]], what: str = "facts", **options) -> DataFrame:
    """A table of SHAPES[what]: a row for each of (repo_id, folder or URL), read where its task runs."""
    spark.dataSource.register(Repositories)
    reader = spark.read.format("repositories").option("what", what).option("repositories", json.dumps(repositories))
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load()
