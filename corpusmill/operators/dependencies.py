"""Dependency manifests to (file_path, ecosystem, name, version), candidates to look up, and their status."""

from __future__ import annotations

import json
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

OUT = "file_path string, ecosystem string, name string, version string, source string, resolved boolean, ord int"
# A requirement of a file, one of a project table, and the entries of locks and of Ruby's files.
REQUIREMENT = re.compile(r"^([A-Za-z0-9_.-]+)\s*([<>=!~;\[].*)?$")
PROJECT_REQUIREMENT = re.compile(r"^([A-Za-z0-9_.-]+)\s*(\[[^\]]*\])?\s*(.*)$")
PNPM_ENTRY = re.compile(r"(?m)^\s{2,}/?([\w@./-]+)@([\w.\-+]+):")
GEM = re.compile(r"""(?m)^\s*gem\s+['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?""")
GO_BLOCK, GO_LINE = re.compile(r"(?s)require\s*\((.*?)\)"), re.compile(r"(?m)^[ \t]*require[ \t]+([^\s(]\S*)[ \t]+(\S+)")


def _table(value: object) -> dict:
    return value if isinstance(value, dict) else {}


def _list(value: object) -> list:
    return value if isinstance(value, list) else []


def _spec(text: str) -> tuple[str, str]:
    m = PROJECT_REQUIREMENT.match(text.strip())
    return (m[1], m[3].strip()) if m else ("", "")


def _version(value: object) -> str:
    """A version, or what stands for one: that of a table, else its Python and markers; a list's parts."""
    if isinstance(value, dict):
        return str(value["version"]) if value.get("version") else ", ".join([*([f"python {value['python']}"] if value.get("python") else []), *([str(value["markers"])] if value.get("markers") else [])])
    return ", ".join(map(str, value)) if isinstance(value, list) else str(value)


def package_json(text: str, file: str):
    data = _table(json.loads(text))
    for kind in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
        yield from ((n, str(v), kind) for n, v in _table(data.get(kind)).items())


def requirements(text: str, file: str):
    for line in text.splitlines():
        bare = line.strip()
        if bare.startswith("-"):
            continue
        bare = bare.split("#", 1)[0].strip()
        if bare and not bare.startswith(("http://", "https://", ".")) and (m := REQUIREMENT.match(bare)):
            yield m[1], (m[2] or "").strip(), file


def pyproject(text: str, file: str):
    data = tomllib.loads(text)
    project, poetry = _table(data.get("project")), _table(_table(data.get("tool")).get("poetry"))
    yield from ((*_spec(d), "project.dependencies") for d in _list(project.get("dependencies")) if isinstance(d, str))
    for name, group in _table(project.get("optional-dependencies")).items():
        yield from ((*_spec(d), f"optional-dependencies.{name}") for d in _list(group) if isinstance(d, str))
    tables = [(poetry.get("dependencies"), "tool.poetry.dependencies"), *((_table(g).get("dependencies"), f"tool.poetry.group.{n}") for n, g in _table(poetry.get("group")).items())]
    for table, source in tables:
        yield from ((n, _version(v), source) for n, v in _table(table).items() if n.lower() != "python")


def package_lock(text: str, file: str):
    data = _table(json.loads(text))
    packages = _table(data.get("packages"))
    for path, v in packages.items():
        if path not in ("", ".") and isinstance(v, dict):
            yield str(v.get("name") or path.rpartition("/")[2] or path), str(v.get("version") or ""), file
    if not packages:  # the first version of the format
        yield from ((n, str(_table(v).get("version", "")), file) for n, v in _table(data.get("dependencies")).items())


def pipfile_lock(text: str, file: str):
    yield from ((n, str(_table(v).get("version", "")), file) for n, v in _table(_table(json.loads(text)).get("default")).items())


def yarn_lock(text: str, file: str):
    """The version is the range that was asked for."""
    for line in text.splitlines():
        if line.endswith(":") and line[0] not in " \t#":
            name, _, version = line.rstrip(":").split(",")[0].strip().strip('"').rpartition("@")
            yield name, version.lstrip("^~"), file


def pnpm_lock(text: str, file: str):
    yield from ((m[1].rpartition("/")[2], m[2], file) for m in PNPM_ENTRY.finditer(text))


def toml_lock(text: str, file: str):
    yield from ((str(p["name"]), str(p.get("version", "")), file) for p in _list(tomllib.loads(text).get("package")) if isinstance(p, dict) and p.get("name"))


def gemfile(text: str, file: str):
    yield from ((m[1], m[2] or "", file) for m in GEM.finditer(text))


def composer(text: str, file: str):
    data = _table(json.loads(text))
    for kind in ("require", "require-dev"):
        yield from ((n, str(v), kind) for n, v in _table(data.get(kind)).items())
    yield from ((str(p["name"]), str(p.get("version", "")), "packages") for p in _list(data.get("packages")) if isinstance(p, dict) and p.get("name"))


def go_mod(text: str, file: str):
    """The first block, then single lines; a block's bracket is no name."""
    block = GO_BLOCK.search(text)
    for line in block[1].splitlines() if block else []:
        parts = line.split("//")[0].split()
        if len(parts) >= 2:
            yield parts[0], parts[1], file
    yield from ((m[1], m[2], file) for m in GO_LINE.finditer(text))


def go_sum(text: str, file: str):
    for line in text.splitlines():
        parts = line.split()
        if len(parts) >= 2 and not parts[1].endswith("/go.mod"):
            yield parts[0], parts[1].lstrip("v"), file


def cargo_toml(text: str, file: str):
    data = tomllib.loads(text)
    for kind in ("dependencies", "dev-dependencies", "build-dependencies"):
        yield from ((n, v if isinstance(v, str) else str(_table(v).get("version", "")), f"cargo.{kind}") for n, v in _table(data.get(kind)).items())


# File name: (ecosystem, whether versions are resolved, parser). Ruby's grammar reads Pipfile too.
PARSERS = {
    "package.json": ("npm", False, package_json), "package-lock.json": ("npm", True, package_lock), "yarn.lock": ("npm", True, yarn_lock), "pnpm-lock.yaml": ("npm", True, pnpm_lock),
    "requirements.txt": ("pypi", False, requirements), "requirements-dev.txt": ("pypi", False, requirements), "dev-requirements.txt": ("pypi", False, requirements), "pyproject.toml": ("pypi", False, pyproject),
    "poetry.lock": ("pypi", True, toml_lock), "uv.lock": ("pypi", True, toml_lock), "pipfile.lock": ("pypi", True, pipfile_lock), "pipfile": ("rubygems", False, gemfile), "cargo.toml": ("crates.io", False, cargo_toml),
    "cargo.lock": ("crates.io", True, toml_lock), "gemfile": ("rubygems", False, gemfile), "gemfile.lock": ("rubygems", False, gemfile), "composer.json": ("packagist", False, composer), "composer.lock": ("packagist", True, composer),
    "go.mod": ("go", True, go_mod), "go.sum": ("go", True, go_sum),
}


def _parse(kept: list[str]):
    def run(batches):
        for pdf in batches:
            rows = []
            for path, content, *own in zip(pdf["file_path"], pdf["content"], *(pdf[c] for c in kept), strict=True):
                file = path.rpartition("/")[2]
                ecosystem, resolved, parser = PARSERS[file.lower()]
                try:
                    found = [x for x in parser(content or "", file) if x[0]]
                except (ValueError, AttributeError, TypeError, KeyError):  # a broken manifest has no dependencies
                    found = []
                rows += [(path, ecosystem, n, v, s, resolved, i, *own) for i, (n, v, s) in enumerate(found)]
            yield pd.DataFrame(rows, columns=["file_path", "ecosystem", "name", "version", "source", "resolved", "ord", *kept])

    return run


def dependencies(files: DataFrame) -> DataFrame:
    """The dependencies of every manifest among files(repo_id?, file_path, content, ord?); only manifests reach Python.

    A manifest's place in its repository, where there is one, is kept as file_ord.
    """
    if "ord" in files.columns:
        files = files.withColumnRenamed("ord", "file_ord")
    kept = [c for c in ("repo_id", "file_ord") if c in files.columns]
    wanted = files.filter(F.lower(X.basename(F.col("file_path"))).isin(*PARSERS)).select("file_path", "content", *kept)
    return wanted.mapInPandas(_parse(kept), ", ".join([OUT, *(f"{c} {dict(wanted.dtypes)[c]}" for c in kept)]))


def candidates(deps: DataFrame, repo: list[str] | None = None) -> DataFrame:
    """repo, ecosystem, name, version, declared_in, ord: each dependency once (case aside), in the order first seen.

    The first pinned version, else the first; the first manifest, else the first lock. Manifests come in the order
    file_ord where there is one, else by path; entries as they stand (ord). Python itself is none.
    """
    repo, first = repo or [], ["file_ord"] if "file_ord" in deps.columns else []
    place = [*first, "file_path", "ord"]
    named = deps.withColumn("name", F.btrim("name")).filter((F.lower("name") != "python") & (F.col("name") != "")).withColumn("pinned", X.pinned_version(F.col("version")))
    merged = named.groupBy(*repo, "ecosystem", F.lower("name").alias("key")).agg(
        F.min_by("name", F.struct(*place)).alias("name"), F.min_by("version", F.struct((F.col("pinned") == "").alias("loose"), *place)).alias("version"), F.min_by("file_path", F.struct("resolved", *place)).alias("declared_in"), F.min(F.struct(*place)).alias("seen"),
    ).drop("key")
    if not repo:
        return merged.withColumnRenamed("seen", "ord")
    return merged.withColumn("ord", F.row_number().over(Window.partitionBy(*repo).orderBy("seen"))).drop("seen")


def evidence(deps: DataFrame) -> DataFrame:
    """name, files: up to two manifests that name it."""
    return deps.groupBy("name").agg(F.array_join(F.slice(F.array_sort(F.collect_set("file_path")), 1, 2), ",").alias("files"))
