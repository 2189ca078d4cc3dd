"""The reference graph: import specifiers resolved to files, degrees, neighbourhoods, the hub."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import held

# Endings tried in this order, emitted endings, and beginnings that are never files.
ENDINGS = [".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".rb", ".php", ".cs", ".kt", ".lua"]
EMITTED = {".js": ".ts", ".jsx": ".tsx", ".mjs": ".mts", ".cjs": ".cts"}
EXTERNAL = ["node:", "http://", "https://", "data:", "file:", "fs", "path", "os", "react", "next", "vue", "svelte", "angular", "lodash", "axios", "express"]


#: Place of a path that a base names as it stands, after every ending.
_LITERAL = 99


def _repo(df: DataFrame) -> Column:
    return F.col("repo_id") if "repo_id" in df.columns else F.lit("").alias("repo_id")


def _join(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _answers(paths: DataFrame) -> DataFrame:
    """(repo_id, kind, key, found): for each way to name a file the best one of that name; found is (rank, depth, path).

    Kind b: a base is the path without its ending (in the order of ENDINGS), the folder of a package or index file,
    the base with an emitted ending, or the path itself. Kind s: every ending of such a base (but the emitted and
    the literal), so that a search by suffix is an equi-join. Kind d: a stem in its folder. Keys are unique: what is
    joined never multiplies, however many files share a name.
    """
    path, depth = F.col("path"), 1 - F.size(F.split("path", "/"))
    paths = paths.withColumn("ending", F.regexp_extract(path, r"(\.[^./]*)$", 1)).withColumns({
        "bare": F.expr("substring(path, 1, length(path) - length(ending))"), "folder": X.dirname(path),
        "at": F.array_position(F.array(*map(F.lit, ENDINGS)), F.col("ending")).cast("int"), "emitted": X.lookup({v: k for k, v in EMITTED.items()}, F.col("ending")),
    })
    bare, folder, at, index = F.col("bare"), F.col("folder"), F.col("at"), F.col("bare").rlike(r"(^|/)index$")
    name = lambda rank, base: F.struct(rank.alias("rank"), base.alias("base"))
    plain = [F.when(at > 0, name(1 + at, bare)), F.when((at > 0) & index, name(2 + len(ENDINGS) + at, folder)), F.when(path.rlike(r"(^|/)__init__\.py$"), name(F.lit(2 + len(ENDINGS)), folder))]
    cases = [F.when(F.col("emitted").isNotNull(), name(F.lit(0), F.concat(bare, "emitted"))), F.when(F.col("emitted").isNotNull() & index, name(F.lit(1), F.concat(folder, "emitted")))]
    some = lambda xs: F.filter(F.array(*xs), lambda x: x.isNotNull())
    named = paths.withColumns({"depth": depth, "plain": some(plain), "other": some([*cases, name(F.lit(_LITERAL), path)])})
    found = lambda rank: F.struct(rank.alias("rank"), "depth", "path").alias("found")
    bases = named.select("repo_id", "depth", "path", F.explode(F.concat("plain", "other")).alias("x")).select("repo_id", F.lit("b").alias("kind"), F.col("x.base").alias("key"), found(F.col("x.rank")))
    pieces = F.split(F.col("x.base"), "/")
    tails = named.select("repo_id", "depth", "path", F.explode("plain").alias("x")).filter("x.base <> ''").select("repo_id", "depth", "path", "x", F.explode(F.transform(pieces, lambda p, i: F.array_join(F.slice(pieces, i + 1, F.size(pieces)), "/"))).alias("key"))
    stems = named.select("repo_id", F.lit("d").alias("kind"), F.concat(X.dirname(path), F.lit("/"), X.stem(path)).alias("key"), found(F.lit(0)))
    return bases.unionByName(tails.select("repo_id", F.lit("s").alias("kind"), "key", found(F.col("x.rank")))).unionByName(stems).groupBy("repo_id", "kind", "key").agg(F.min("found").alias("found"))


def resolve(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges(repo_id, source, target), externals(repo_id, source, specifier)) of files(repo_id?, file_path, imports).

    A specifier is relative (dots as in Python, or ./ and ../), rooted, or bare. Each asks for one to five names in
    order (``_answers``), all in one join by (repo_id, kind, name); the first that is a file of the repository wins.
    A bare one asks for itself beside its source and at the root, then, if it is a single word, for that stem in
    those folders, then for any path that ends with it, the deepest first. Self-imports are neither edge nor
    external; null and blank specifiers and files without a path are left out.
    """
    known = held.cut(files.select(_repo(files), X.normalise_path(F.col("file_path")).alias("path")).filter("path <> ''").distinct())
    every = asked = files.select(_repo(files), X.normalise_path(F.col("file_path")).alias("source"), F.explode("imports").alias("raw")).filter("source <> '' and trim(raw) <> ''").distinct()
    stripped, s, folder = F.btrim("raw"), F.col("s"), F.col("folder")
    split = F.contains(stripped, F.lit(" import "))
    asked = asked.withColumns({
        "s": F.when(split, F.btrim(F.substring_index(stripped, " import ", 1))).otherwise(stripped),
        "tail": F.when(split, F.btrim(F.split_part(F.btrim(F.regexp_extract(stripped, r"(?s)^.*? import (.*)$", 1)), F.lit(","), F.lit(1)))).otherwise(""),
        "folder": X.dirname(F.col("source")),
    })
    outside = reduce(lambda a, b: a | b, [F.startswith(s, F.lit(e)) for e in EXTERNAL]) & ~s.rlike(r"^[./]")
    slashed = s.rlike(r"^\.\.?/")
    kind = F.when(outside, "external").when(F.startswith(s, F.lit(".")) & ~slashed, "python").when(slashed, "path").when(F.startswith(s, F.lit("/")), "root").otherwise("bare")
    asked = asked.withColumn("shape", kind)
    norm = X.normalise_path
    of = lambda shapes, p: F.when(F.col("shape").isin(shapes), norm(p))  # noqa: E731  null where no name is made of it
    level, parts = F.length(F.regexp_extract(s, r"^(\.+)", 1)), F.split(folder, "/")
    up = F.when(level <= 1, folder).otherwise(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level + 1, F.lit(0))), "/"))
    rest = F.replace(F.regexp_replace(s, r"^\.+", ""), F.lit("."), F.lit("/"))
    # each of these is a column of its own, made once and used by several names
    asked = asked.withColumns({"up": up, "rest": rest, "here": of(["path", "bare"], _join(folder, s)), "alone": of(["bare"], s), "root": F.regexp_replace(F.substring(s, 2, 1 << 20), "/+$", "")})
    up, rest, tail, here, alone, from_root = (F.col(c) for c in ("up", "rest", "tail", "here", "alone", "root"))
    asked = asked.withColumns({"inner": of(["python"], _join(up, rest)), "beside": of(["python"], _join(up, tail)), "rooted": of(["root"], from_root)})
    inner, beside = F.col("inner"), F.col("beside")
    asked = asked.withColumn("within", F.when((tail != "") & inner.isNotNull(), norm(_join(inner, tail))).otherwise(inner))
    ask = lambda kind, key, place, literal: F.struct(F.lit(kind).alias("kind"), key.alias("key"), F.lit(place).alias("place"), F.lit(literal).alias("literal"))
    python = (
        F.when((rest == "") & (tail != ""), F.array(ask("b", beside, 0, False), ask("b", up, 1, True)))
        .when(rest == "", F.array(ask("b", up, 1, True)))
        .otherwise(F.array(ask("b", F.col("within"), 0, True)))
    )
    bare = F.array(
        F.when(here != "", ask("b", here, 0, False)), F.when(alone != "", ask("b", alone, 1, False)),
        F.when(~s.rlike("[./]"), ask("d", F.concat(folder, F.lit("/"), s), 2, False)), F.when(~s.rlike("[./]"), ask("d", F.concat(F.lit("/"), s), 2, False)),
        F.when(alone != "", ask("s", F.replace(alone, F.lit("."), F.lit("/")), 3, False)),
    )
    rooted = F.array(F.when((from_root == "") | (F.col("rooted") != ""), ask("b", F.col("rooted"), 0, True)))
    names = F.when(F.col("shape") == "python", python).when(F.col("shape") == "path", F.array(ask("b", here, 0, True))).when(F.col("shape") == "root", rooted).when(F.col("shape") == "bare", bare)
    wanted = asked.select("repo_id", "source", "raw", F.explode(F.filter(names, lambda x: x.isNotNull())).alias("x")).select("repo_id", "source", "raw", "x.*")
    # a specifier asks for several names and few are files: only those go on, and meet what asked for them once more
    met = wanted.join(_answers(known), ["repo_id", "kind", "key"]).filter((F.col("found.rank") < _LITERAL) | F.col("literal"))
    best = met.groupBy("repo_id", "source", "raw").agg(F.min(F.struct("place", "found")).alias("f")).select("repo_id", "source", "raw", F.col("f.found.path").alias("target"))
    joined = held.cut(every.join(best, ["repo_id", "source", "raw"], "left"))
    edges = joined.filter("target <> source").select("repo_id", "source", "target").distinct()
    return edges, joined.filter("target is null").select("repo_id", "source", F.col("raw").alias("specifier"))


def degrees(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, fan_in, fan_out over distinct edges without loops; nodes(node) adds those without any."""
    pairs = edges.select("source", "target").filter("source <> target").distinct()
    both = pairs.select(F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(pairs.select(F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    if nodes is not None:
        both = both.unionByName(nodes.select("node", F.lit(0).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def metrics(edges: DataFrame, nodes: DataFrame, externals: DataFrame) -> DataFrame:
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return one(nodes, "file_count").crossJoin(one(edges.filter("source <> target").distinct(), "link_count")).crossJoin(one(externals.select("specifier").distinct(), "external_import_count"))


def hub(edges: DataFrame) -> DataFrame:
    """The node of most links, then most fan-in, then least name."""
    d = degrees(edges).withColumn("degree", F.col("fan_in") + F.col("fan_out")).filter("degree > 0")
    return d.orderBy(F.desc("degree"), F.desc("fan_in"), "node").limit(1)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from pa.Table.from_batches([batch]).group_by("node").aggregate([("other", "distinct")]).select(["node", "other_distinct"]).rename_columns(["node", "others"]).to_batches()


def links(edges: DataFrame) -> DataFrame:
    """node, others: the nodes that are linked to a node, either way, in as many rows as it takes.

    Rows are dealt by node, and dealt anew where a node has too many for one task. A row's others are distinct and no
    more than an Arrow batch holds; a link that edges repeat may stand in several rows.
    """
    ends = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("other")), F.struct(F.col("target").alias("node"), F.col("source").alias("other")))
    both = edges.filter("source <> target").select(F.inline(ends)).hint("rebalance", F.col("node")).sortWithinPartitions("node")
    kind = dict(both.dtypes)
    return both.mapInArrow(_gathered, f"node {kind['node']}, others array<{kind['other']}>")


def neighbourhood(edges: DataFrame, starts: DataFrame, hops: int = 1) -> DataFrame:
    """start, node, hop: what ``hops`` links or fewer reach from starts(start), either way; each node at its least hop.

    A hop deals the lists of links by start, not a row for each link: what a start meets more than once goes where the lists
    are opened, before anything is dealt again.
    """
    ways = held.cut(links(edges))
    front = seen = held.cut(starts.select("start", F.col("start").alias("node"), F.lit(0).alias("hop")).distinct())
    for k in range(1, hops + 1):
        met = front.join(ways, "node").select("start", "others").hint("rebalance", F.col("start"))
        reached = met.select("start", F.explode("others").alias("node")).distinct().withColumn("hop", F.lit(k))
        # each hop is held: the plan of the next one has two tables, however many came before
        front = held.cut(reached.join(seen, ["start", "node"], "left_anti"))
        if front.isEmpty():
            break
        seen = held.cut(seen.unionByName(front))
    return seen.filter("hop > 0")


def dependents(edges: DataFrame) -> DataFrame:
    """node, dependents, dependencies: sorted lists."""
    down = edges.groupBy(F.col("target").alias("node")).agg(F.array_sort(F.collect_set("source")).alias("dependents"))
    up = edges.groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_set("target")).alias("dependencies"))
    none = F.array().cast("array<string>")
    return down.join(up, "node", "full").select("node", F.coalesce("dependents", none).alias("dependents"), F.coalesce("dependencies", none).alias("dependencies"))


def node_values(deg: DataFrame) -> DataFrame:
    """Adds val = 1 + 7 * fan_in / the largest fan_in, and whether the node has a link."""
    top = deg.agg(F.greatest(F.lit(1), F.max("fan_in")).alias("top"))
    return deg.crossJoin(F.broadcast(top)).select("node", "fan_in", "fan_out", (1 + 7 * F.col("fan_in") / F.col("top")).alias("val"), ((F.col("fan_in") + F.col("fan_out")) > 0).alias("linked"))


def related(edges: DataFrame, files: DataFrame, cap: int = 2) -> DataFrame:
    """file_path, other: up to ``cap`` files beside each one: linked either way, or of the same folder, by path.

    Of a folder only the first cap + 1 files can stand beside another as neighbours, so no more meet the rest.
    """
    keys = [c for c in ("repo_id",) if c in files.columns]
    pairs = edges.select(*keys, F.col("source").alias("file_path"), F.col("target").alias("other"))
    linked = pairs.unionByName(pairs.select(*keys, F.col("other").alias("file_path"), F.col("file_path").alias("other"))).withColumn("far", F.lit(0))
    placed = files.select(*keys, "file_path", X.dirname(F.col("file_path")).alias("dir"))
    first = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "dir").orderBy("file_path"))).filter(F.col("_n") <= cap + 1).select(*keys, "dir", F.col("file_path").alias("other"))
    beside = placed.join(first, [*keys, "dir"]).filter("file_path <> other").select(*keys, "file_path", "other", F.lit(1).alias("far"))
    both = linked.unionByName(beside).filter("file_path <> other").groupBy(*keys, "file_path", "other").agg(F.min("far").alias("far"))
    return both.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "file_path").orderBy("far", "other"))).filter(F.col("n") <= cap).select(*keys, "file_path", "other")
