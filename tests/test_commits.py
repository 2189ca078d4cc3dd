"""The registry under writers at once, failures, old versions and odd rows."""

import datetime
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import commits

NOW = datetime.datetime(2024, 1, 1)
SCHEMA = "n int, text string"


def shot(spark, repo: str | None, *ns: int):
    return spark.createDataFrame([(repo, f"url/{repo}", n, f"t{n}", "extra") for n in ns], "repo_id string, repo_url string, n int, text string, commit string")


def rows(registry, version=None):
    return sorted((r.repo_id, r.n) for r in registry.read(version).collect())


def test_writers_at_once(spark, tmp_path):
    registry = commits.Registry(spark, f"file://{tmp_path}/r s", SCHEMA)
    assert registry.version() == 0 and rows(registry) == []
    with ThreadPoolExecutor(4) as pool:
        got = list(pool.map(lambda k: commits.Registry(spark, f"file://{tmp_path}/r s", SCHEMA).save(shot(spark, f"w{k}", k, k + 10), NOW), range(4)))
    assert sorted(got) == registry.versions() == [1, 2, 3, 4]
    assert rows(registry) == sorted([(f"w{k}", n) for k in range(4) for n in (k, k + 10)])
    for v in registry.versions():
        assert len(rows(registry, v)) == 2 * v


def test_one_of_two_takes_a_version(spark, tmp_path):
    registry = commits.Registry(spark, str(tmp_path), SCHEMA)
    with ThreadPoolExecutor(8) as pool:
        took = list(pool.map(lambda k: registry._put(1, {"registry": str(k)}), range(8)))
    assert took.count(True) == 1 and registry._body(1)["registry"] == str(took.index(True))
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.endswith(".json") and p.name != f"{1:020d}.json"]
    own = registry._path("log", "own")
    registry._fs("log").create(own, False).close()
    assert not registry._rename(own, registry._path("log", f"{1:020d}.json")) and registry._rename(own, registry._path("log", f"{2:020d}.json"))


def test_a_failed_save_leaves_nothing(spark, tmp_path, monkeypatch):
    registry = commits.Registry(spark, str(tmp_path), SCHEMA)
    registry.save(shot(spark, "a", 1), NOW)
    left = lambda: (sorted(p.name for p in (tmp_path / "data").iterdir()), sorted(p.name for p in (tmp_path / "registry").iterdir()), registry.versions())
    before = left()
    with pytest.raises(Exception, match="boom|USER_RAISED"):
        registry.save(shot(spark, "b", 1).withColumn("n", F.when(F.col("n") == 1, F.raise_error(F.lit("boom"))).cast("int")), NOW)
    with pytest.raises(ValueError, match="without a repo_id"):
        registry.save(shot(spark, None, 1), NOW)
    monkeypatch.setattr(commits.Registry, "_put", lambda self, version, body: False)
    with pytest.raises(commits.Conflict):
        registry.save(shot(spark, "b", 1), NOW, tries=2)
    assert left() == before and rows(registry) == [("a", 1)]


def test_versions_expiry_and_sweep(spark, tmp_path):
    registry = commits.Registry(spark, str(tmp_path), SCHEMA)
    hour = datetime.timedelta(hours=1)
    registry.save(shot(spark, "a", 1, 1), NOW)
    registry.save(shot(spark, "a", 2).unionByName(shot(spark, "b", 3)), NOW + hour)
    registry.save(shot(spark, "c", 4), NOW + 26 * hour)  # a and b are past their time
    assert rows(registry, 1) == [("a", 1), ("a", 1)] and rows(registry, 2) == [("a", 2), ("b", 3)] and rows(registry) == [("c", 4)]
    registry.save(shot(spark, "d", 5), NOW + 27 * hour, most=1)
    assert rows(registry) == [("d", 5)]
    registry.save(shot(spark, "e", 6), NOW + 27 * hour)
    assert registry.expire(NOW + 60 * hour, keep="d") == 6 and rows(registry) == [("d", 5)]
    assert registry.forget(shot(spark, "d", 5, 5)) == 7 and rows(registry) == [] and rows(registry, 6) == [("d", 5)]
    assert registry.sweep(grace_seconds=3600) == []
    assert len(registry.sweep(versions=2, grace_seconds=0)) == 5 + 4  # registries of versions 1 to 5, data of all saves but d's
    assert registry.versions() == [6, 7] and rows(registry, 6) == [("d", 5)]
