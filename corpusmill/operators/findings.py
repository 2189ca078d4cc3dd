"""Findings after the scan: order, verdicts, fixes, references, duplicates, summaries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


def survived() -> Column:
    """Not dismissed; a missing triage is live."""
    return ~F.col("triage").eqNullSafe(F.lit("dismissed"))


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(X.severity_rank(F.col("severity")), "file_path", "line")


def with_place(findings: DataFrame, repo: list[str]) -> DataFrame:
    """Adds ``ord``, the place in severity order; one task for each repository."""
    return findings.withColumn("ord", F.row_number().over(Window.partitionBy(*repo).orderBy(X.severity_rank(F.col("severity")), "file_path", "line", "id")))


def renumber(findings: DataFrame, repo: list[str]) -> DataFrame:
    """ord from 1 in each repository, in the order it had; for the few findings that are sent on."""
    return findings.withColumn("ord", F.row_number().over(Window.partitionBy(*repo).orderBy("ord")))


def batches(findings: DataFrame, size: int = 12) -> DataFrame:
    return findings.withColumn("batch_id", F.floor((F.col("ord") - 1) / size).cast("int"))


#: What a reviewer's verdict makes of a finding, and the severities it may set.
VERDICTS = {"confirm": "confirmed", "downgrade": "downgraded", "dismiss": "dismissed", "escalate": "escalated"}
RATED = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def apply_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Left join on (batch_id, id); of repeated verdicts the last (seq) holds. Unknown ones change nothing.

    A verdict sets triage and triage_note (800 characters), and the recommendation (1,200) if it has one. A severity
    that differs is taken, unless the finding is dismissed, and the one before is kept as original_severity.
    ``gap`` says why a finding has no usable verdict: skipped or unrecognised.
    """
    last = verdicts.groupBy("batch_id", "id").agg(F.max_by(F.struct("verdict", F.col("severity").alias("v_severity"), "explanation", F.col("recommendation").alias("v_recommendation")), "seq").alias("v"))
    j = findings.join(last, ["batch_id", "id"], "left").withColumn("said", F.lower(F.btrim(F.col("v.verdict"))))
    heard = F.coalesce(F.col("said").isin(*VERDICTS), F.lit(False))
    rated = F.upper(F.btrim(F.col("v.v_severity")))
    changes = F.coalesce(heard & (F.col("said") != "dismiss") & rated.isin(*RATED) & (rated != F.upper(F.coalesce("severity", F.lit("")))), F.lit(False))
    advice = F.substring(F.btrim(F.coalesce("v.v_recommendation", F.lit(""))), 1, 1200)
    return j.select(
        *[c for c in findings.columns if c not in ("triage", "severity", "recommendation")],
        F.coalesce(F.when(heard, X.lookup(VERDICTS, F.col("said"))), "triage", F.lit("unreviewed")).alias("triage"),
        F.when(changes, rated).otherwise(F.col("severity")).alias("severity"),
        F.when(changes, F.col("severity")).alias("original_severity"),
        F.when(heard, F.substring(F.coalesce("v.explanation", F.lit("")), 1, 800)).alias("triage_note"),
        F.when(heard & (advice != ""), advice).otherwise(F.col("recommendation")).alias("recommendation"),
        F.when(F.col("v").isNull(), "skipped").when(~heard, "unrecognised").alias("gap"),
    )


def triage_accounts(reviewed: DataFrame, failed_batches: DataFrame | None = None) -> DataFrame:
    """One row: findings by triage, and gaps: in failed batches (batch_id), skipped by the reviewer, of an unknown verdict."""
    lost = F.lit(False)
    if failed_batches is not None:
        reviewed = reviewed.join(failed_batches.select("batch_id", F.lit(True).alias("_lost")).distinct(), "batch_id", "left")
        lost = F.coalesce("_lost", F.lit(False))
    gap = F.col("gap") if "gap" in reviewed.columns else F.lit(None).cast("string")
    return reviewed.agg(
        *[F.count_if(F.col("triage") == t).alias(t) for t in (*VERDICTS.values(), "pending", "unreviewed")],
        F.count_if(lost).alias("lost"), F.count_if(~lost & (gap == "skipped")).alias("skipped"), F.count_if(~lost & (gap == "unrecognised")).alias("unrecognised"), F.count(F.lit(1)).alias("total"),
    )


def fix_targets(findings: DataFrame, repo: list[str], most: int = 24) -> DataFrame:
    """The first ``most`` live findings of each repository, in order (ord)."""
    return budgeted(findings.filter(survived()), [F.col("ord")], most, repo).filter("within").drop("within")


def model_findings(said: DataFrame) -> DataFrame:
    """Findings that a reviewer adds: said(file_path, line, name, severity, description, snippet, recommendation), all texts.

    Without a path or a description there is none. Severities unknown are MEDIUM, lines unreadable 0; the id has the name, in lower case
    with hyphens, at most 40 characters.
    """
    t = lambda c: F.btrim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    name = F.when(t("name") == "", "Model-reported issue").otherwise(F.substring(t("name"), 1, 120))
    level, line = F.upper(t("severity")), F.coalesce(F.col("line").try_cast("bigint"), F.lit(0).cast("bigint"))
    return said.filter((t("file_path") != "") & (t("description") != "")).select(
        *[c for c in said.columns if c == "repo_id"],
        F.concat_ws(":", F.lit("model"), F.substring(F.replace(F.lower(name), F.lit(" "), F.lit("-")), 1, 40), t("file_path"), line).alias("id"), F.lit("model_review").alias("rule"), name.alias("name"),
        F.when(level.isin(*RATED), level).otherwise("MEDIUM").alias("severity"), F.substring(t("description"), 1, 1200).alias("description"), t("file_path").alias("file_path"), line.alias("line"),
        F.substring(F.coalesce("snippet", F.lit("")), 1, 200).alias("snippet"), F.substring(F.coalesce("recommendation", F.lit("")), 1, 1200).alias("recommendation"),
        F.lit("model").alias("detector"), F.lit("low").alias("confidence"), F.lit("model-review").alias("source"), F.lit("unverified").alias("triage"),
        F.lit("Reported by the reviewer; no rule found it.").alias("triage_note"),
    )


def with_model(findings: DataFrame, extra: DataFrame) -> DataFrame:
    """Both kinds together; a finding equal in every column stands once."""
    return findings.unionByName(extra, allowMissingColumns=True).distinct()


def apply_fixes(findings: DataFrame, fixes: DataFrame) -> DataFrame:
    """By id, fixes(id, recommendation, effort, breaking_change, seq?); of repeated ones the last, of those with advice."""
    order = F.col("seq") if "seq" in fixes.columns else F.xxhash64("recommendation", "effort")
    advice = F.substring(F.btrim("recommendation"), 1, 1500).alias("f_rec")
    kept = fixes.filter((F.coalesce("id", F.lit("")) != "") & (F.btrim(F.coalesce("recommendation", F.lit(""))) != ""))
    own = kept.groupBy("id").agg(F.max_by(F.struct(advice, F.lower(F.btrim(F.coalesce("effort", F.lit("")))).alias("fix_effort"), F.coalesce("breaking_change", F.lit(False)).alias("fix_breaking_change")), order).alias("f")).select("id", "f.*")
    return findings.join(own, "id", "left").withColumn("recommendation", F.coalesce(F.when(F.col("f_rec") != "", F.col("f_rec")), "recommendation")).drop("f_rec")


def apply_references(findings: DataFrame, references: DataFrame) -> DataFrame:
    """By id, references(id, reference): the search that grounds a finding, one for each id."""
    return findings.join(references.groupBy("id").agg(F.min("reference").alias("reference")), "id", "left")


def groundable(findings: DataFrame, rules_with_query: list[str]) -> DataFrame:
    return findings.filter(survived() & (F.col("rule").isin(*rules_with_query) | F.col("triage").isin("confirmed", "escalated")))


def budgeted(df: DataFrame, order: list, budget: int, keys: list[str]) -> DataFrame:
    """Adds ``within``: whether a row is among the first ``budget`` of its keys."""
    return df.withColumn("within", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) <= budget)


def dedupe_static(findings: DataFrame) -> DataFrame:
    """One finding for each (repo_id, file_path, line, lowered name): the most severe, then the first (ord). For findings of the scan alone."""
    key = F.struct(X.severity_rank(F.col("severity")).alias("r"), "ord")
    return findings.groupBy(*_place(findings), F.lower(F.btrim("name")).alias("key")).agg(F.min_by(F.struct(*findings.columns), key).alias("w")).select("w.*")


def _place(findings: DataFrame) -> list[str]:
    return [c for c in ("repo_id", "file_path", "line") if c in findings.columns]


def _add(kept: list[dict], row: dict) -> None:
    """Puts a finding to those of its place: merged with the first that it restates, or beside them."""
    rank, judged = {s: i for i, s in enumerate(X.SEVERITIES)}, ("confirmed", "escalated")
    bare = lambda r: str(r["name"] or "").strip().lower()
    at = next((i for i, k in enumerate(kept) if bare(k) == bare(row) or "model-review" in (k["source"], row["source"])), None)
    if at is None:
        kept.append(row)
        return
    first = kept[at]
    worse = rank.get(str(row["severity"] or "LOW").upper(), 9) < rank.get(str(first["severity"] or "LOW").upper(), 9)
    winner, loser = (dict(row), first) if worse else (dict(first), row)
    winner |= {c: loser[c] for c in ("snippet", "recommendation", "description", "triage_note") if not winner.get(c) and loser.get(c)}
    if loser["triage"] in judged and winner["triage"] not in judged:
        winner["triage"] = loser["triage"]
    if loser["source"] == "static-analysis" and winner["source"] == "model-review":
        winner["source"] = loser["source"]
    if not worse and row["triage"] and row["triage"] != "unverified" and row.get("triage_note"):
        winner["triage_note"] = row["triage_note"]
    kept[at] = winner


def _merge_batches(keys: list[str]):
    """Rows sorted by place and order, place after place: only the findings of one are held."""

    def run(batches):
        kept: list[dict] = []
        schema = None
        for batch in batches:
            schema, done = batch.schema, []
            for row in batch.to_pylist():
                if kept and any(kept[0][k] != row[k] for k in keys):
                    done, kept = done + kept, []
                _add(kept, row)
            yield pa.RecordBatch.from_pylist(done, schema)
        if kept:
            yield pa.RecordBatch.from_pylist(kept, schema)

    return run


def dedupe(findings: DataFrame) -> DataFrame:
    """Merges the findings of a place (repo_id, file_path, line) in order: equal names, or either side from a model, are one.

    The more severe one wins, then the earlier; the other gives what the winner lacks. Takes what ``scan.findings``
    and ``model_findings`` give: a missing triage_note is null, and a missing ord is the order of severity, path,
    line and id within the place. A place is a small group.
    """
    if "triage_note" not in findings.columns:
        findings = findings.withColumn("triage_note", F.lit(None).cast("string"))
    if "ord" not in findings.columns:
        findings = findings.withColumn("ord", F.row_number().over(Window.partitionBy(*_place(findings)).orderBy(X.severity_rank(F.col("severity")), "id")))
    keys = _place(findings)
    return findings.repartition(*keys).sortWithinPartitions(*keys, "ord").mapInArrow(_merge_batches(keys), findings.schema)


def summary(findings: DataFrame) -> DataFrame:
    """severity, total, dismissed: live findings by upper-cased severity (LOW where blank), and the dismissed ones."""
    name = F.upper(F.when(F.coalesce("severity", F.lit("")) == "", "LOW").otherwise(F.col("severity")))
    return findings.groupBy(name.alias("severity")).agg(F.count_if(survived()).alias("total"), F.count_if(~survived()).alias("dismissed"), F.count_distinct(F.when(survived(), F.col("file_path"))).alias("files_affected"))


def region(findings: DataFrame, files: DataFrame, radius: int, numbered: bool = False) -> DataFrame:
    """Adds ``region``: the lines around each finding, with their numbers if ``numbered``; empty for an unknown file or line."""
    keys = [c for c in ("repo_id", "file_path") if c in findings.columns and c in files.columns]
    text = X.clean_lines(F.col("content"))
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n")
    first = F.greatest(F.lit(1), F.col("line") - radius).cast("int")
    cut = F.slice(lines, first, F.greatest(F.lit(0), F.col("line") + radius - first + 1).cast("int"))
    said = F.transform(cut, lambda x, i: F.concat((i + first).cast("string"), F.lit(": "), x)) if numbered else cut
    here = (F.col("line") > 0) & (F.coalesce("content", F.lit("")) != "")
    return findings.join(files.select(*keys, "content"), keys, "left").withColumn("region", F.when(here, F.array_join(said, "\n")).otherwise("")).drop("content")


def find(findings: DataFrame, id: str = "", file_path: str = "", line: int = 0) -> DataFrame:
    """The finding of that id, else the first of the file (and line, unless 0)."""
    here = (F.col("file_path") == file_path) & ((F.lit(line) == 0) | (F.col("line") == line))
    return findings.filter((F.col("id") == id) | here).orderBy(F.col("id") != id, "ord").limit(1)
