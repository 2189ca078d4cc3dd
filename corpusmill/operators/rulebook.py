"""Rules as a table: thousands of patterns over texts, of which an automaton over all anchors says which a text may fire."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import scan

SCHEMA = "id string, name string, severity string, pattern string, description string, recommendation string, anchors array<array<string>>, languages array<string>, skip_comments boolean, gate string"
_KINDS = {part.split(" ")[0]: part.split(" ")[1] for part in SCHEMA.split(", ")}
#: Characters of patterns and anchors that one pass over the texts holds in each task: some 50,000 rules.
BLOCK_CHARS = 4_000_000
_PLAIN = re.compile(r"[\w \t/@#&:;,<>=!~'\"%-]+")


def table(spark: SparkSession, rules: Sequence[scan.Rule] = scan.RULES) -> DataFrame:
    """Rules as rows of ``SCHEMA``; gate is a cheaper pattern, of lowered text, that every match satisfies."""
    gates = {scan.ASSIGNMENT: scan._ASSIGNED, scan.RULES[0].pattern: scan._ASSIGNED}
    rows = [(r.id, r.name, r.severity, r.pattern, r.description, r.recommendation, [list(g) for g in r.anchors], list(r.languages), r.skip_comments, gates.get(r.pattern)) for r in rules]
    return spark.createDataFrame(rows, SCHEMA)


def _lowered(text: Column) -> Column:
    return F.lower(F.upper(text))


def _whole(rules: DataFrame) -> DataFrame:
    """Every column of ``SCHEMA``, once for each distinct rule. A pattern of plain characters is its own anchor where none is given."""
    some = rules.select(*[(F.col(c) if c in rules.columns else F.lit(None)).cast(kind).alias(c) for c, kind in _KINDS.items()]).filter("pattern <> ''")
    given = F.filter("anchors", lambda g: g.isNotNull() & ~F.exists(g, lambda a: F.coalesce(a, F.lit("")) == ""))
    own = F.when(F.col("pattern").rlike(f"^{_PLAIN.pattern}$"), F.array(F.array("pattern"))).otherwise(F.array().cast("array<array<string>>"))
    low = F.transform(F.when(F.size("anchors") > 0, given).otherwise(own), lambda g: F.transform(g, _lowered))
    return some.select("id", "name", "severity", "pattern", "description", "recommendation", low.alias("anchors"), F.coalesce("languages", F.array().cast("array<string>")).alias("languages"), F.coalesce("skip_comments", F.lit(False)).alias("skip_comments"), "gate").distinct()


def _candidates(wanted: list[list[list[str]]]) -> Callable[[str], list[int]]:
    """Which rules may fire on a lowered text: those of whose every anchor group one member stands in it, and those without groups."""
    import ahocorasick

    groups: dict[frozenset[str], int] = {}
    needs = [{groups.setdefault(frozenset(g), len(groups)) for g in anchors} for anchors in wanted]
    users: list[list[int]] = [[] for _ in groups]
    for no, need in enumerate(needs):
        for g in need:
            users[g].append(no)
    holders: dict[str, list[int]] = {}
    for members, g in groups.items():
        for anchor in members:
            holders.setdefault(anchor, []).append(g)
    automaton, lists = ahocorasick.Automaton(), list(holders.values())
    for k, anchor in enumerate(holders):
        automaton.add_word(anchor, k)
    automaton.make_automaton()
    always = [no for no, need in enumerate(needs) if not need]

    def fired(low: str) -> list[int]:
        met = {k for _, k in automaton.iter(low)} if lists else set()
        seen: dict[int, int] = {}
        for g in {g for k in met for g in lists[k]}:
            for no in users[g]:
                seen[no] = seen.get(no, 0) + 1
        return sorted(always + [no for no, n in seen.items() if n == len(needs[no])])

    return fired


def _tried(wanted: list[list[list[str]]]) -> Callable:
    """``_candidates`` over Arrow batches; the automaton is made once a task."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        fired = _candidates(wanted)
        for batch in batches:
            yield batch.map(fired)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<int>")


def _checked(spark: SparkSession, rows: list) -> None:
    """Raises for rules whose patterns Java can't read, and says which."""
    compiled, broken = spark._jvm.java.util.regex.Pattern, []
    for row in rows:
        try:
            compiled.compile(row.pattern)
        except Exception:  # noqa: BLE001  what the gateway raises is a class of its own
            broken.append(row.id)
    if broken:
        raise ValueError(f"broken patterns: {', '.join(map(str, broken[:20]))}")


def _one_pass(texts: DataFrame, keys: list[str], rows: list, per_rule: int) -> DataFrame:
    spark = texts.sparkSession
    _checked(spark, rows)
    said = ["id", "name", "severity", "pattern", "description", "recommendation", "languages", "skip_comments", "gate"]
    shape = ", ".join(["no int", *[f"{c} {_KINDS[c]}" for c in said]])
    block = spark.createDataFrame([(no, *[r[c] for c in said]) for no, r in enumerate(rows)], shape).withColumnRenamed("id", "rule")
    pairs = texts.select(*keys, "language", "content", "low", F.explode(_tried([r.anchors for r in rows])("low")).alias("no")).join(F.broadcast(block), "no")  # at most BLOCK_CHARS
    known = F.coalesce(F.col("language"), F.lit("")) == ""
    fires = pairs.filter((F.size("languages") == 0) | known | F.array_contains("languages", F.col("language"))).filter(F.col("gate").isNull() | F.rlike("low", F.col("gate"))).filter(F.rlike("content", F.col("pattern")))
    marked = F.transform(F.split(F.regexp_replace("content", F.col("pattern"), F.lit(scan._CUT + "$0")), "\n"), lambda x, i: F.struct((i + 1).alias("line"), x.alias("text")))
    hits = F.transform(F.filter(marked, lambda h: F.contains(h["text"], F.lit(scan._CUT))), lambda h: F.struct(h["line"].alias("line"), F.replace(h["text"], F.lit(scan._CUT), F.lit("")).alias("text")))
    spared = lambda h: F.col("skip_comments") & (X.is_comment(h["text"]) | X.snippet(h["text"]).rlike(X.LOW_SIGNAL))
    return fires.withColumn("h", F.explode(F.slice(F.filter(hits, lambda h: ~spared(h)), 1, per_rule))).select(
        F.concat_ws(":", "rule", "file_path", "h.line").alias("id"), *keys, "rule", "name", "severity", "description", F.col("h.line").cast("bigint").alias("line"), X.snippet(F.col("h.text")).alias("snippet"), "recommendation",
        F.lit("pattern").alias("detector"), F.lit("medium").alias("confidence"), F.lit("static-analysis").alias("source"), F.lit("pending").alias("triage"),
    )


def findings(files: DataFrame, rules: DataFrame, per_rule: int = scan.PER_RULE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Located findings of files(repo_id?, file_path, content, language?, ...) by rules(id, pattern, ...: ``SCHEMA``, what is missing is null).

    What ``scan.rule_findings`` finds with the same rules, at a cost that grows with the rules a text may fire, not with
    the rules there are: one automaton over all anchors reads a text once (in Arrow batches), and the patterns it leaves
    are joined to the text and run in the JVM. No shuffle. Rules beyond ``block_chars`` take a pass over the files for each
    block, so that no task holds more. A rule without anchors is tried on every text, unless its pattern is plain text.
    Repeated rules count once; two rules of one id both count; an empty or null pattern finds nothing, a broken one raises
    before any text is read; without rules or files there are no findings. A language that is null or empty fits every rule.
    """
    spark, keys, rules = files.sparkSession, scan._keys(files), _whole(rules)
    size = F.sum(F.length("pattern") + F.aggregate(F.flatten("anchors"), F.lit(0), lambda n, a: n + F.length(a)) + 16)
    blocks = max(1, -(-int(rules.agg(F.coalesce(size, F.lit(0)).alias("n")).first().n) // block_chars))
    texts, found = scan.texts(files), None
    for b in range(blocks):
        rows = rules.filter(F.pmod(F.xxhash64("id", "pattern"), F.lit(blocks)) == b).orderBy("id", "pattern").collect()  # a block of bounded size
        part = _one_pass(texts, keys, rows, per_rule)
        found = part if found is None else found.unionByName(part)
    return found
