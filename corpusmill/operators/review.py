"""Passes that ask someone else (a model, a search): requests as rows, answers as rows, joins around them.

A provider is any function from a prompt to an answer, called in Arrow batches on the executors, or a table of answers
given beforehand, which makes a pass a join. Nothing here opens a connection of its own.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import findings, patches, tools

# Sizes of a batch, searches a run may make, how long to wait before trying again, and the domains and queries of guidance.
TRIAGE_BATCH, FIX_BATCH, FIX_TARGETS = 12, 8, 24
ADVISORIES, VERSIONS, GROUNDED = 8, 5, 3
FIRST_WAIT, LONGEST_WAIT, LONGEST_ASKED = 0.75, 8.0, 30.0
GUIDANCE_DOMAINS = ["owasp.org", "cheatsheetseries.owasp.org", "cwe.mitre.org", "nvd.nist.gov"]
GUIDANCE = {
    "hardcoded_secret": "hardcoded credentials in source code remediation secret management OWASP",
    "high_entropy_value": "detecting and rotating leaked API keys and secrets OWASP",
    "shell_injection": "OS command injection prevention subprocess shell false OWASP",
    "sql_injection": "SQL injection prevention parameterised queries OWASP",
    "path_traversal": "path traversal prevention directory traversal OWASP",
    "weak_hash": "SHA-1 deprecation HMAC signing digest replace SHA-256 NIST transition away",
    "insecure_random": "cryptographically secure random number generation OWASP",
    "unsafe_deserialization": "insecure deserialization pickle yaml load OWASP",
    "code_execution": "code injection eval exec dynamic code execution OWASP",
    "insecure_transport": "disabling TLS certificate verification risks OWASP",
    "xss_innerhtml": "cross-site scripting prevention output encoding OWASP",
    "open_redirect": "open redirect prevention unvalidated redirects OWASP",
    "cors_wildcard": "CORS misconfiguration wildcard origins OWASP",
    "jwt_none_algorithm": "JSON web token verification algorithm confusion OWASP",
    "aws_access_key": "AWS access key ID compromised revoke IAM credentials rotation",
    "private_key_block": "private key committed to source repository remove rotate OWASP",
    "github_token": "GitHub personal access token leaked revoke secret rotation",
    "slack_token": "Slack token leaked revoke app credentials rotation",
    "debug_mode": "Python Flask debug mode production security stack trace disclosure",
}
REGISTRIES = {"pypi": "PyPI", "npm": "npm", "go": "Go modules", "crates.io": "crates.io", "rubygems": "RubyGems", "packagist": "Packagist"}

# ---- providers


class Unavailable(Exception):
    """A provider that may answer later; ``after`` says in how many seconds, if it said."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def wait_before(attempt: int, after: float | None = None, rng: random.Random | None = None) -> float:
    """Seconds before another try: what was asked for, at most 30; else up to 0.75 doubled with each attempt, at most 8."""
    if after is not None:
        return min(max(0.0, after), LONGEST_ASKED)
    return (rng or random).uniform(0.0, min(FIRST_WAIT * 2**attempt, LONGEST_WAIT))


def call(provider: Callable[[str], str], prompt: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str]:
    """(answer, attempts, error): tried again while the provider is unavailable; any other error is final."""
    for k in range(attempts):
        try:
            return provider(prompt), k + 1, ""
        except Unavailable as e:
            if k + 1 == attempts:
                return None, k + 1, str(e)[:300]
            sleep(wait_before(k, e.after))
        except Exception as e:  # noqa: BLE001  what a caller's function raises becomes a row
            return None, k + 1, str(e)[:300]
    return None, attempts, "not tried"


ANSWERS = "request_id string, answer string, attempts int, error string"


def ask(requests: DataFrame, provider: Callable[[str], str] | DataFrame, at_once: int = 4, attempts: int = 3) -> DataFrame:
    """(request_id, answer, attempts, error) of requests(request_id, prompt).

    provider: a function, called by ``at_once`` tasks at most, or a table (request_id, answer) of what it would say.
    A request without an answer has a null one and an error, so a lost batch is a row and not a lost run.
    """
    if isinstance(provider, DataFrame):
        said = provider.groupBy("request_id").agg(F.max("answer").alias("answer"))
        return requests.select("request_id").join(said, "request_id", "left").select("request_id", "answer", F.lit(1).alias("attempts"), F.when(F.col("answer").isNull(), "no answer").otherwise("").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, *call(provider, p, attempts)) for r, p in zip(pdf["request_id"], pdf["prompt"], strict=True)]
            yield pd.DataFrame(rows, columns=["request_id", "answer", "attempts", "error"])

    return requests.select("request_id", "prompt").repartition(at_once, "request_id").mapInPandas(run, ANSWERS)


def answers_json(answers: DataFrame) -> DataFrame:
    """Adds ``data``, the VARIANT that ``exprs.extract_json`` finds in the answer."""
    return answers.withColumn("data", X.extract_json(F.col("answer")))


# ---- triage and fixes


def candidates(found: DataFrame, files: DataFrame, radius: int = 4) -> DataFrame:
    """Findings with batch_id and ``payload``, the JSON a reviewer sees: what was reported, where, and the lines around it."""
    placed = findings.region(findings.batches(found, TRIAGE_BATCH), files, radius, numbered=True)
    body = F.struct(
        "id", "rule", "detector", F.col("severity").alias("reported_severity"), "file_path", "line", "description", F.substring("snippet", 1, 300).alias("matched_line"),
        F.when(F.col("region") != "", F.col("region")).alias("surrounding_code"),
    )
    return placed.withColumn("payload", F.to_json(body)).drop("region")


def requests(rows: DataFrame, repo: list[str], head: str, step: str) -> DataFrame:
    """One request for each (repo, batch_id): request_id and the prompt, ``head`` and the batch's payloads in order (ord)."""
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "payload"))), lambda x: x["payload"]), ",\n")
    key = F.concat_ws("/", F.lit(step), *[F.col(c).cast("string") for c in (*repo, "batch_id")])
    return rows.groupBy(*repo, "batch_id").agg(listed.alias("said")).select(*repo, "batch_id", key.alias("request_id"), F.concat(F.lit(head + "\n["), "said", F.lit("]")).alias("prompt"))


_VERDICT = "array<struct<id:string,verdict:string,severity:string,explanation:string,recommendation:string>>"
_EXTRA = "array<struct<file_path:string,line:string,name:string,severity:string,description:string,snippet:string,recommendation:string>>"
_FIX = "array<struct<id:string,recommendation:string,effort:string,breaking_change:boolean>>"


def _listed(data: str, path: str, shape: str) -> Column:
    return F.coalesce(F.try_variant_get(data, path, shape), F.array().cast(shape))


def triage(found: DataFrame, files: DataFrame, provider: Callable[[str], str] | DataFrame, repo: list[str], head: str = "Judge these candidates.") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(findings with verdicts, findings the reviewer adds, batches without an answer) of located findings (ord in each repository).

    A reviewer answers a batch of twelve with {"verdicts": [...], "additional_findings": [...]}; a verdict counts
    within its own batch. A batch that fails leaves its findings unjudged.
    """
    batched = candidates(found, files)
    asked = requests(batched, repo, head, "triage")
    said = asked.drop("prompt").join(answers_json(ask(asked, provider)), "request_id")
    verdicts = said.select(*repo, "batch_id", F.posexplode(_listed("data", "$.verdicts", _VERDICT)).alias("seq", "v")).select(*repo, "batch_id", "seq", "v.*").filter("id <> ''")
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in (*repo, "batch_id")])  # a batch is one of its repository
    judged = findings.apply_verdicts(batched.drop("payload").withColumn("batch_id", key), verdicts.withColumn("batch_id", key).drop(*repo))
    extra = findings.model_findings(said.select(*repo, F.explode(_listed("data", "$.additional_findings", _EXTRA)).alias("x")).select(*repo, "x.*"))
    return judged, extra, said.filter("data is null").select(key.alias("batch_id"), "error")


def remediate(found: DataFrame, files: DataFrame, provider: Callable[[str], str] | DataFrame, repo: list[str], head: str = "Say how to mend these.") -> DataFrame:
    """The findings with the advice that a reviewer gives the first 24 live ones of a repository, in batches of eight."""
    targets = findings.fix_targets(found, repo, FIX_TARGETS).drop("batch_id")
    placed = findings.region(findings.batches(findings.renumber(targets, repo), FIX_BATCH), files, 3, numbered=True)
    body = F.struct("id", "name", "severity", "file_path", "line", F.substring("snippet", 1, 200).alias("matched_line"), F.substring("recommendation", 1, 200).alias("scanner_recommendation"), F.col("region").alias("surrounding_code"))
    asked = requests(placed.withColumn("payload", F.to_json(body)), repo, head, "fixes")
    said = answers_json(ask(asked, provider)).select("request_id", F.posexplode(_listed("data", "$.fixes", _FIX)).alias("at", "f"))
    return findings.apply_fixes(found, said.select("f.*", F.struct("request_id", "at").alias("seq")))


# ---- searches


def advisory_query(name: Column, version: Column, ecosystem: Column) -> Column:
    """The words of a search for advisories; the pinned version stands in them if there is one."""
    pinned = X.pinned_version(version)
    label = F.coalesce(X.lookup(REGISTRIES, ecosystem), F.lit("package registry"))
    return F.concat_ws(" ", name, F.when(pinned != "", pinned), label, F.lit("security advisory CVE known vulnerabilities"))


def version_query(name: Column, ecosystem: Column, year: int = 2026) -> Column:
    label = F.coalesce(X.lookup(REGISTRIES, ecosystem), F.lit("package registry"))
    return F.concat(F.lit("latest stable released version of the "), name, F.lit(" package on "), label, F.lit(f" {year}"))


def rule_query(rule: Column, name: Column) -> Column:
    """The words of a search for guidance on a rule; of another finding its name."""
    return F.coalesce(X.lookup(GUIDANCE, rule), F.concat(F.coalesce(name, F.lit("vulnerability")), F.lit(" remediation OWASP")))


def with_budget(deps: DataFrame, repo: list[str], advisories: int = ADVISORIES, versions: int = VERSIONS) -> DataFrame:
    """Candidates (ord) with the searches that they get: the first eight of a repository for advisories, the first five for versions."""
    first = findings.budgeted(deps, [F.col("ord")], advisories, repo).withColumnRenamed("within", "ask_advisory")
    return findings.budgeted(first, [F.col("ord")], versions, repo).withColumnRenamed("within", "ask_version").withColumns({
        "advisory_query": F.when(F.col("ask_advisory"), advisory_query(F.col("name"), F.col("version"), F.col("ecosystem"))),
        "version_query": F.when(F.col("ask_version"), version_query(F.col("name"), F.col("ecosystem"))),
    })


STATUS = ["name", "version", "ecosystem", "declared_in", "kind", "status", "reason", "severity", "cves", "fixed_in", "latest_version", "behind_by", "summary", "query"]


def verify(deps: DataFrame, answers: DataFrame, repo: list[str], advisories: int = ADVISORIES, versions: int = VERSIONS) -> DataFrame:
    """What searches say of a repository's candidates (repo, name, version, ecosystem, declared_in, ord): rows of STATUS.

    answers(query, answer, snippets): the answer of a search, and its sources' texts. An advisory makes a package
    vulnerable if the text names it and a CVE; a version outdated if a later one is called current. What the budget
    leaves out, and searches without an answer, are unverified with a reason. Of several answers to a query the greatest counts.
    """
    asked = with_budget(deps, repo, advisories, versions)
    kinds = F.array(F.struct(F.lit("advisory").alias("kind"), F.col("advisory_query").alias("query")), F.struct(F.lit("version").alias("kind"), F.col("version_query").alias("query")))
    each = asked.select(*repo, "name", "version", "ecosystem", "declared_in", "ord", F.explode(F.filter(kinds, lambda k: k["query"].isNotNull() | (k["kind"] == "advisory"))).alias("k")).select("*", "k.*").drop("k")
    known = answers.groupBy("query").agg(F.max(F.struct("answer", F.coalesce("snippets", F.lit("")).alias("snippets"))).alias("a"))
    j = each.join(known, "query", "left")
    answer, text = F.coalesce("a.answer", F.lit("")), F.concat_ws("\n", F.coalesce("a.answer", F.lit("")), F.when(F.col("a.snippets") != "", F.col("a.snippets")))
    pinned, cves = X.parse_version(X.pinned_version(F.col("version"))), X.cves(text)
    latest = X.latest_version(F.when(answer != "", answer).otherwise(F.col("a.snippets")))
    advisory, silent, later = F.col("kind") == "advisory", F.col("a").isNull(), F.col("latest") > F.col("pinned")
    j = j.withColumns({"pinned": pinned, "latest": latest, "cves": cves, "text": text, "answer": answer})
    vulnerable = advisory & (F.size("cves") > 0) & F.contains(F.lower("text"), F.lower("name"))
    status = (
        F.when(F.col("query").isNull() | silent, "unverified").when(vulnerable, "vulnerable").when(advisory, "checked")
        .when(F.col("pinned").isNull() | F.col("latest").isNull(), "unverified").when(later, "outdated").otherwise("checked")
    )
    reason = F.when(F.col("query").isNull(), "not checked: per-run search budget reached").when(silent, F.concat("kind", F.lit(" search failed"))).when((status == "unverified"), "no parsable version in the search answer")
    dotted = F.array_join(F.transform("latest", lambda x: x.cast("string")), ".")
    fixed = X.fixed_in(F.col("text"))
    short = F.when(X.pinned_version(F.col("version")) != "", X.pinned_version(F.col("version"))).otherwise(F.substring(F.coalesce("version", F.lit("")), 1, 40))
    return j.select(
        *repo, "name", short.alias("version"), "ecosystem", "declared_in", "kind", status.alias("status"), reason.alias("reason"),
        F.when(vulnerable, X.severity_from_text(F.when(F.col("answer") != "", F.col("answer")).otherwise(F.col("text")))).alias("severity"), F.when(vulnerable, F.array_join("cves", ",")).alias("cves"),
        F.when(vulnerable & (fixed != ""), F.concat(F.lit(">= "), fixed)).alias("fixed_in"), F.when(~advisory & ~silent & F.col("pinned").isNotNull(), dotted).alias("latest_version"),
        F.when(status == "outdated", X.distance_behind(F.col("pinned"), F.col("latest"))).alias("behind_by"), F.when(vulnerable, X.evidence_line(F.when(F.col("answer") != "", F.col("answer")).otherwise(F.col("text")))).alias("summary"), "query",
    )


def verification_counts(checked: DataFrame, repo: list[str]) -> DataFrame:
    """repo, declared, queries_run and the number of rows of each status."""
    ran = F.col("query").isNotNull() & ~F.coalesce(F.endswith("reason", F.lit("search failed")), F.lit(False))
    return checked.groupBy(*repo).agg(F.count_distinct("ecosystem", F.lower("name")).alias("declared"), F.count_if(ran).alias("queries_run"), *[F.count_if(F.col("status") == s).alias(s) for s in ("vulnerable", "outdated", "checked", "unverified")])


def ground(found: DataFrame, answers: DataFrame, repo: list[str], most: int = GROUNDED) -> DataFrame:
    """id, query, answer, sources (of the restricted search, else of the open one) for the first groundable findings (ord) of a repository.

    answers(query, restricted, answer, sources): sources is an array; a restricted search without any is made again openly. Of several
    answers to a query the greatest counts.
    """
    targets = findings.budgeted(findings.groundable(found, list(GUIDANCE)), [F.col("ord")], most, repo).filter("within").select(*repo, "id", rule_query(F.col("rule"), F.col("name")).alias("query"))
    side = lambda restricted, name: answers.filter(F.col("restricted") == restricted).groupBy("query").agg(F.max(F.struct("answer", "sources")).alias(name))
    both = targets.join(side(True, "own"), "query", "left").join(side(False, "open"), "query", "left")
    used = F.when(F.size("own.sources") > 0, F.col("own")).when(F.col("own").isNotNull(), F.col("open"))
    return both.withColumn("used", used).filter("used is not null").select(*repo, "id", "query", F.substring("used.answer", 1, 600).alias("answer"), F.slice("used.sources", 1, 3).alias("sources"))


# ---- architecture

# The names under which an answer may hold each part, and the wrappers it may stand in.
ALIASES = {
    "summary": ["summary", "overview", "description"],
    "pattern": ["pattern", "architecture_pattern", "style"],
    "layers": ["layers", "components", "modules", "boundaries"],
    "entry_points": ["entry_points", "entrypoints", "entry_points_list"],
    "data_flow": ["data_flow", "dataflow", "flow"],
    "extension_points": ["extension_points", "extensionpoints", "extension_points_list"],
    "risks": ["risks", "risk", "concerns"],
}
WRAPPERS = ["architecture", "result", "data", "analysis", "output"]


_OBJECTS = {
    "layers": (8, {"name": ["name"], "files": ["files"], "responsibility": ["responsibility"]}),
    "entry_points": (10, {"file_path": ["file_path", "location", "file"], "role": ["role", "description"], "calls": ["calls"]}),
    "extension_points": (8, {"file_path": ["file_path", "location"], "how": ["how"]}),
    "risks": (8, {"file_path": ["file_path", "location"], "risk": ["risk"]}),
}
ARCHITECTURE = "struct<summary:string,pattern:string,data_flow:array<string>,extracted:boolean," + ",".join(f"{k}:array<struct<{','.join(f'{x}:string' for x in fields)}>>" for k, (_, fields) in _OBJECTS.items()) + ">"


def clean(data: object) -> dict:
    """The parts of an architecture, whatever names its author chose; ``extracted`` says if there was any.

    They stand at the top, or in the first wrapper that has a summary or layers. Texts are cut to 2,000 and 400
    characters, lists to 8 or 10; a text in the place of an object is its first field, and values are texts.
    """
    told = lambda v: v if isinstance(v, str) else json.dumps(v)

    def first(part: object, key: str) -> object:
        return next((v for n in ALIASES[key] if isinstance(part, dict) and (v := part.get(n)) not in (None, "", [], {})), None)

    root = next((p for p in (data, *[data.get(w) for w in WRAPPERS if isinstance(data, dict)]) if first(p, "summary") or first(p, "layers")), data)
    out: dict = {"summary": told(first(root, "summary") or "")[:2000], "pattern": told(first(root, "pattern") or "")[:400], "extracted": bool(first(root, "summary") or first(root, "layers"))}
    flow = first(root, "data_flow")
    out["data_flow"] = [t for x in (flow if isinstance(flow, list) else []) if (t := told(x).strip())][:10]
    for key, (most, fields) in _OBJECTS.items():
        items, kept = first(root, key), []
        for item in items[:most] if isinstance(items, list) else []:
            if isinstance(item, dict):  # of several names for a field the last one that is there holds
                entry = {f: told(item[n]) for f, names in fields.items() for n in names if n in item}
            else:
                entry = {next(iter(fields)): item.strip()} if isinstance(item, str) and item.strip() else {}
            if entry:
                kept.append({f: entry.get(f) for f in fields})
        out[key] = kept
    return out


def clean_architecture(answers: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``architecture`` of the answers (keys, answer) in which JSON can be found: one small text for each repository."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [tools.recover(t) for t in pdf["answer"]]
            kept = pdf[[isinstance(x, dict) for x in found]][keys].reset_index(drop=True)
            yield kept.assign(architecture=pd.Series([clean(x) for x in found if isinstance(x, dict)], dtype=object))

    types = dict(answers.dtypes)
    return answers.select(*keys, "answer").mapInPandas(run, ", ".join([*[f"{k} {types[k]}" for k in keys], f"architecture {ARCHITECTURE}"]))


def architecture(facts: DataFrame, provider: Callable[[str], str] | DataFrame, repo: list[str], head: str = "Describe this repository.") -> DataFrame:
    """repo and architecture: facts(repo, facts: JSON) are asked about, one request each, and the answer is cleaned."""
    asked = facts.select(*repo, F.concat_ws("/", F.lit("architecture"), *[F.col(c).cast("string") for c in repo]).alias("request_id"), F.concat(F.lit(head + "\n"), F.substring("facts", 1, 20_000)).alias("prompt"))
    return clean_architecture(asked.drop("prompt").join(ask(asked, provider), "request_id"), repo)


# ---- patches

PATCH_RADIUS, PATCH_TRIES = 60, 2
PROPOSED = "id string, file_path string, diff string, explanation string, risk string, applies boolean, validation string, attempts int"


def propose(found: DataFrame, files: DataFrame, provider: Callable[[str], str], head: str = "Mend this with a unified diff, as JSON.", tries: int = PATCH_TRIES) -> DataFrame:
    """(id, file_path, diff, explanation, risk, applies, validation, attempts): a patch for each finding, checked against its file.

    The provider sees the 60 lines around the finding. A diff is cleaned, anchored anew and applied to the file as it
    is; one that does not apply is asked for once more, with the reason. Without a file, a region or a diff there is
    none, and validation says why.
    """
    text = findings.region(found, files, PATCH_RADIUS, numbered=True).join(files.select("file_path", "content"), "file_path", "left")

    def one(row: dict) -> tuple:
        own = (row["id"], row["file_path"])
        if not row["content"]:
            return *own, "", "", "unknown", False, f"{row['file_path']} is not readable", 0
        if not (row["region"] or "").strip():
            return *own, "", "", "unknown", False, f"line {row['line']} is outside {row['file_path']}", 0
        facts = json.dumps({k: row.get(k) for k in ("file_path", "line", "name", "severity", "description", "snippet", "recommendation")})
        diff, said, risk, reason, k = "", "", "unknown", "", 0
        for k in range(1, tries + 1):
            answer, _, error = call(provider, "\n\n".join([head, facts, row["region"], *([f"The last diff did not apply: {reason}"] if reason else [])]))
            data = tools.recover(answer or "")
            if not isinstance(data, dict):
                return *own, diff, said, risk, False, error or reason or "no usable patch", k
            said, risk = str(data.get("explanation", ""))[:1500], str(data.get("risk", "unknown")).strip().lower() or "unknown"
            raw = str(data.get("diff", ""))
            cleaned = "" if patches.unsafe(raw) else patches.clean(raw)
            if not cleaned:
                return *own, "", said, risk, False, "explained, but no diff", k
            diff = patches.reanchor(row["content"], cleaned, row["file_path"]) or cleaned
            _, reason = patches.apply(row["content"], diff, strict=True)
            if not reason:
                return *own, diff, said, risk, True, "", k
        return *own, diff, said, risk, False, reason, k

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(r) for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in PROPOSED.split(", ")])

    kept = [c for c in ("id", "file_path", "line", "name", "severity", "description", "snippet", "recommendation", "region", "content") if c in text.columns]
    return text.select(*kept).mapInPandas(run, PROPOSED)
