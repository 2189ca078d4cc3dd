"""Repositories as a data source: local folders, clones, heads, logs, and what is none."""

import subprocess

import pytest

from corpusmill.operators import churn
from corpusmill.sources import git, repositories


@pytest.fixture(scope="module")
def repos(tmp_path_factory):
    """Six repositories of one to six commits, each commit touching one file more."""
    top, made = tmp_path_factory.mktemp("repos"), []
    for k in range(1, 7):
        folder = top / f"r{k}"
        folder.mkdir()
        git_ = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=A", "-c", "user.email=a@x", *a], check=True, capture_output=True)  # noqa: B023, E731
        git_("init", "-q")
        for n in range(k):
            (folder / f"f{n}.py").write_text("x\n" * (n + 1))
            git_("add", "-A")
            git_("commit", "-q", "-m", f"c{n}")
        made.append((f"r{k}", str(folder)))
    return made


def test_facts_side_by_side(spark, repos, tmp_path):
    df = repositories.read(spark, [*repos, ("none", str(tmp_path)), ("gone", "/nowhere/at/all")], tries=1)
    assert df.rdd.getNumPartitions() == 8
    out = {r.repo_id: r for r in df.collect()}
    assert [out[f"r{k}"].commits for k in range(1, 7)] == [1, 2, 3, 4, 5, 6] and all(out[r].head_sha == git.head(f) and out[r].error == "" for r, f in repos)
    assert (out["none"].error, out["none"].commits) == ("no repository", 0) and "cloned" in out["gone"].error


def test_clones_heads_and_depth(spark, repos):
    urls = [(r, f"file://{f}") for r, f in repos]
    heads = {r.repo_id: r.head_sha for r in repositories.read(spark, [*urls, ("bad", "file:///nowhere")], "heads", tries=2).collect()}
    assert heads == {r: git.head(f) for r, f in repos} | {"bad": ""}
    shallow = {r.repo_id: (r.commits, r.is_shallow) for r in repositories.read(spark, urls, "facts", depth=2).collect()}
    assert shallow["r1"] == (1, False) and shallow["r6"] == (2, True)
    assert {r.repo_id: r.commits for r in repositories.read(spark, urls, "facts", depth=2, deepen=3).collect()}["r6"] == 5
    assert {r.error != "" for r in repositories.read(spark, urls, "facts", most_bytes=10, tries=1).collect()} == {True}


def test_logs_feed_churn(spark, repos):
    """Logs from the source give what the driver's own reading gives."""
    own = git.logs(spark, dict(repos))
    there = repositories.read(spark, repos, "log").select("repo_id", "log")
    assert sorted(map(tuple, there.collect())) == sorted(map(tuple, own.collect()))
    lines = repositories.read(spark, repos, "lines").select("repo_id", "log")
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, git.logs(spark, dict(repos), lines=True).collect()))
    assert sorted(map(tuple, churn.parse_log(there).collect())) == sorted(map(tuple, churn.parse_log(own).collect()))


def test_no_repositories(spark):
    assert repositories.read(spark, []).count() == 0
