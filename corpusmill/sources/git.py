"""Local repositories read through the git program: clones of local folders, heads, logs, depth. Nothing is fetched unless asked for."""

from __future__ import annotations

import os
import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession

# Seconds a command may take, bytes a clone may have, commits of a log, and how a record is written.
TIMEOUT, MOST_BYTES, COMMITS, DEEPER = 300, 300 << 20, 120, 40
RECORD = "--pretty=format:%x01%H%x02%an%x02%aI"


def run(folder: str | None, *arguments: str, timeout: int = TIMEOUT) -> str:
    """What git prints; empty where it fails or takes too long. It asks nothing and reads no one's settings."""
    env = {"PATH": os.environ.get("PATH", ""), "HOME": "/nonexistent", "GIT_TERMINAL_PROMPT": "0", "GIT_CONFIG_NOSYSTEM": "1", "LC_ALL": "C"}
    try:
        done = subprocess.run(["git", *(["-C", folder] if folder else []), "-c", "safe.directory=*", *arguments], capture_output=True, timeout=timeout, env=env, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return ""
    return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else ""


def size_of(folder: str) -> int:
    return sum(os.lstat(os.path.join(d, f)).st_size for d, _, names in os.walk(folder) for f in names)


def clone(url: str, target: str, depth: int = 1, most_bytes: int = MOST_BYTES) -> str:
    """The folder of a shallow clone; empty, and nothing left behind, where it fails or is too large."""
    run(None, "clone", "--quiet", "--depth", str(depth), "--", url, target)
    if not os.path.isdir(os.path.join(target, ".git")) or size_of(target) > most_bytes:
        shutil.rmtree(target, ignore_errors=True)
        return ""
    return target


def remote_head(url: str) -> str:
    return run(None, "ls-remote", "--", url, "HEAD", timeout=30).split("\t")[0].strip()


def head(folder: str) -> str:
    return run(folder, "rev-parse", "HEAD").strip()


def is_shallow(folder: str) -> bool:
    return run(folder, "rev-parse", "--is-shallow-repository").strip() == "true"


def commit_count(folder: str) -> int:
    return int(run(folder, "rev-list", "--count", "HEAD").strip() or 0)


def deepen(folder: str, depth: int = DEEPER) -> bool:
    """Fetches older commits without their files; whether there are more now."""
    before = commit_count(folder)
    run(folder, "fetch", "--quiet", f"--deepen={depth}", "--filter=blob:none")
    return commit_count(folder) > before


def logs(spark: SparkSession, repos: dict[str, str], lines: bool = False, commits: int = COMMITS) -> DataFrame:
    """(repo_id, log) of folders by repo_id, as ``churn.parse_log`` takes it; with ``lines`` as ``churn.parse_numstat`` does."""
    kind = ["--numstat", "--pretty=format:"] if lines else ["--name-only", RECORD]
    return spark.createDataFrame([(r, run(f, "log", f"-n{commits}", *kind)) for r, f in repos.items()], "repo_id string, log string")


def facts(spark: SparkSession, repos: dict[str, str]) -> DataFrame:
    """repo_id, head_sha, is_shallow, commits; blank, false and 0 where a folder is no repository."""
    return spark.createDataFrame([(r, head(f), is_shallow(f), commit_count(f)) for r, f in repos.items()], "repo_id string, head_sha string, is_shallow boolean, commits int")
