"""Queries over findings, verdicts, searches and prompts. Labelled documents stand in for findings, parts for dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import context, conversations, findings, patches, review
from .registry import list_sql, pick, pick_sql, query, table

_SEVERITY = ["CRITICAL", "high", "MEDIUM", "LOW", "INFO", "odd", ""]
_TRIAGE = ["pending", "confirmed", "dismissed", "escalated", None]
_RANK = "CASE upper({}) WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 WHEN 'INFO' THEN 4 ELSE 9 END"
_RULES = ["weak_hash", "model_review", "debug_mode", "other"]
_FILES = "files AS (SELECT doc_id, 'r' || doc_id % 9 AS repo_id, 'd' || doc_id % 5 || '/f' || doc_id || '.txt' AS file_path, text AS content FROM documents)"
_TRIAGE_SQL = "[" + ", ".join("NULL" if t is None else f"'{t}'" for t in _TRIAGE) + "]"
_FOUND = f"""{_FILES}, found AS (SELECT repo_id, doc_id, 'i' || doc_id AS id, {pick_sql(_RULES, 'doc_id // 2')} AS rule, 'name ' || doc_id % 3 AS name, {pick_sql(_SEVERITY, 'doc_id')} AS severity, file_path,
    CAST(doc_id % 6 AS BIGINT) AS line, {_TRIAGE_SQL}[CAST(doc_id % 5 AS BIGINT) + 1] AS triage, 'do ' || doc_id AS recommendation, row_number() OVER (PARTITION BY repo_id ORDER BY {_RANK.format(pick_sql(_SEVERITY, 'doc_id'))}, file_path, doc_id % 6, 'i' || doc_id) AS ord FROM files)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("r"), (d % 9).cast("string")).alias("repo_id"), F.concat(F.lit("d"), (d % 5).cast("string"), F.lit("/f"), d.cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"), d.alias("ord"))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a finding of every severity, triage and rule in turn, in the order of its repository."""
    d = F.col("doc_id")
    triage = F.element_at(F.array(*[F.lit(t) for t in _TRIAGE]), (d % 5 + 1).cast("int"))
    rows = texts(spark, sf_dir).select(
        "repo_id", "doc_id", F.concat(F.lit("i"), d.cast("string")).alias("id"), pick(_RULES, F.floor(d / 2)).alias("rule"), F.concat(F.lit("name "), (d % 3).cast("string")).alias("name"), pick(_SEVERITY, d).alias("severity"), "file_path", (d % 6).cast("bigint").alias("line"),
        triage.alias("triage"), F.concat(F.lit("do "), d.cast("string")).alias("recommendation"), F.lit("label").alias("detector"), F.lit("told").alias("description"), F.lit("line").alias("snippet"),
    )
    return findings.with_place(rows, ["repo_id"])


@query(f"WITH {_FOUND} SELECT repo_id, id, CAST(ord AS INTEGER) AS ord, CAST((ord - 1) // 12 AS INTEGER) AS batch_id FROM found")
def ranked_findings(spark, sf_dir):
    return findings.batches(found(spark, sf_dir)).select("repo_id", "id", "ord", "batch_id")


_SAID = ["confirm", "Dismiss ", "downgrade", "escalate", "maybe", None]
_VERDICTS = f"""{_FOUND}, said AS (SELECT id, [{', '.join('NULL' if v is None else f"'{v}'" for v in _SAID)}][CAST(doc_id % 6 AS BIGINT) + 1] AS verdict, CASE WHEN doc_id % 7 = 1 THEN 'low' WHEN doc_id % 7 = 2 THEN 'INFO' WHEN doc_id % 7 = 3 THEN 'HIGH' ELSE '' END AS v_severity,
    CASE WHEN doc_id % 4 = 0 THEN 'better ' || doc_id ELSE '' END AS v_rec FROM found WHERE doc_id % 11 <> 0),
    judged AS (SELECT f.*, lower(trim(verdict)) AS v, s.id IS NULL AS skipped, v_severity, v_rec FROM found f LEFT JOIN said s USING (id)),
    out AS (SELECT *, coalesce(v IN ('confirm', 'dismiss', 'downgrade', 'escalate'), false) AS heard FROM judged),
    changed AS (SELECT *, heard AND v <> 'dismiss' AND upper(v_severity) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') AND upper(v_severity) <> upper(severity) AS changes FROM out),
    reviewed AS (SELECT repo_id, id, CASE WHEN heard THEN CASE v WHEN 'confirm' THEN 'confirmed' WHEN 'dismiss' THEN 'dismissed' WHEN 'downgrade' THEN 'downgraded' ELSE 'escalated' END ELSE coalesce(triage, 'unreviewed') END AS triage,
        CASE WHEN changes THEN upper(v_severity) ELSE severity END AS severity, CASE WHEN changes THEN severity END AS original_severity, CASE WHEN heard THEN 'since ' || id END AS triage_note, CASE WHEN heard AND v_rec <> '' THEN v_rec ELSE recommendation END AS recommendation,
        CASE WHEN skipped THEN 'skipped' WHEN NOT heard THEN 'unrecognised' END AS gap FROM changed)"""


def _spoken() -> list:
    d = F.col("doc_id")
    said = F.element_at(F.array(*[F.lit(v) for v in _SAID]), (d % 6 + 1).cast("int"))
    level = F.when(d % 7 == 1, "low").when(d % 7 == 2, "INFO").when(d % 7 == 3, "HIGH").otherwise("")
    return [said.alias("verdict"), level.alias("severity"), F.concat(F.lit("since "), "id").alias("explanation"), F.when(d % 4 == 0, F.concat(F.lit("better "), d.cast("string"))).otherwise("").alias("recommendation")]


@query(f"WITH {_VERDICTS} SELECT * FROM reviewed")
def reviewed_findings(spark, sf_dir):
    """Verdicts joined by batch and id; of repeated ones the last."""
    batched = findings.batches(found(spark, sf_dir)).withColumn("batch_id", F.concat_ws("/", "repo_id", F.col("batch_id").cast("string")))
    rows = batched.filter("doc_id % 11 <> 0").select("batch_id", "id", *_spoken())
    both = rows.withColumn("seq", F.lit(1)).unionByName(rows.filter("verdict = 'confirm'").withColumns({"verdict": F.lit("dismiss"), "seq": F.lit(0)}))
    return findings.apply_verdicts(batched, both).select("repo_id", "id", "triage", "severity", "original_severity", "triage_note", "recommendation", "gap")


@query(f"""WITH {_VERDICTS} SELECT count_if(triage = 'confirmed') AS confirmed, count_if(triage = 'downgraded') AS downgraded, count_if(triage = 'dismissed') AS dismissed, count_if(triage = 'escalated') AS escalated, count_if(triage = 'pending') AS pending,
    count_if(triage = 'unreviewed') AS unreviewed, CAST(0 AS BIGINT) AS lost, count_if(gap = 'skipped') AS skipped, count_if(gap = 'unrecognised') AS unrecognised, count(*) AS total FROM reviewed""")
def triage_accounts(spark, sf_dir):
    """The whole pass: candidates in batches with the lines around them, answers as JSON in a fenced block, verdicts read out of it."""
    f = found(spark, sf_dir)
    spoken = findings.batches(f).filter("doc_id % 11 <> 0").select("repo_id", "batch_id", "ord", F.struct("id", *_spoken()).alias("v"))
    listed = spoken.groupBy("repo_id", "batch_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("ord", "v"))), lambda x: x["v"])).alias("verdicts"))
    answers = listed.select(F.concat_ws("/", F.lit("triage"), "repo_id", F.col("batch_id").cast("string")).alias("request_id"), F.concat(F.lit('Here it is:\n```json\n{"verdicts": '), "verdicts", F.lit(', "additional_findings": [],}\n```')).alias("answer"))
    judged, _, lost = review.triage(f, texts(spark, sf_dir), answers, ["repo_id"])
    return findings.triage_accounts(judged, lost)


_EXTRA = ["Weak key", "", "A  name that is quite a bit longer than forty characters are"]


@query(f"""WITH x AS (SELECT doc_id, {pick_sql(_EXTRA, 'doc_id')} AS name, 'p' || doc_id AS file_path, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE CAST(doc_id % 9 AS VARCHAR) END AS l, {pick_sql(_SEVERITY, 'doc_id')} AS severity FROM documents WHERE doc_id % 5 <> 0),
    y AS (SELECT *, CASE WHEN trim(name) = '' THEN 'Model-reported issue' ELSE trim(name) END AS n, coalesce(TRY_CAST(l AS BIGINT), 0) AS line FROM x)
    SELECT 'model:' || substr(replace(lower(n), ' ', '-'), 1, 40) || ':' || file_path || ':' || line AS id, n AS name, CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(severity) ELSE 'MEDIUM' END AS severity, file_path, line, 'unverified' AS triage FROM y""")
def model_findings(spark, sf_dir):
    """Findings that a reviewer adds; without a description there is none, and equal ones stand once."""
    d = F.col("doc_id")
    said = table(spark, sf_dir, "documents").select(
        pick(_EXTRA, d).alias("name"), F.concat(F.lit("p"), d.cast("string")).alias("file_path"), F.when(d % 4 == 0, "x").otherwise((d % 9).cast("string")).alias("line"), pick(_SEVERITY, d).alias("severity"), F.when(d % 5 != 0, "told").otherwise(" ").alias("description"),
        F.lit(None).cast("string").alias("snippet"), F.lit(None).cast("string").alias("recommendation"),
    )
    made = findings.model_findings(said)
    return findings.with_model(made, made).select("id", "name", "severity", "file_path", "line", "triage")


@query(f"""WITH {_FOUND}, d AS (SELECT *, lower(trim(name)) AS key FROM found) SELECT repo_id, line, key AS name, arg_min(id, {{'r': {_RANK.format('severity')}, 'o': ord}}) AS id FROM d GROUP BY repo_id, line, key""")
def distinct_findings(spark, sf_dir):
    """Findings of a scan alone, many in one place: one for each name."""
    rows = found(spark, sf_dir).withColumn("file_path", F.lit("one.txt"))
    return findings.dedupe_static(rows).select("repo_id", "line", F.lower(F.btrim("name")).alias("name"), "id")


@query(f"""WITH {_FILES}, p AS (SELECT doc_id, file_path, {pick_sql(_SEVERITY, 'doc_id')} AS s1, {pick_sql(_SEVERITY, 'doc_id * 3 + 1')} AS s2, {_TRIAGE_SQL}[CAST(doc_id % 5 AS BIGINT) + 1] AS t1, CASE WHEN doc_id % 2 = 0 THEN 'confirmed' ELSE 'unverified' END AS t2,
        CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'own' END AS r1 FROM files),
    q AS (SELECT *, {_RANK.format("CASE WHEN s2 = '' THEN 'LOW' ELSE s2 END")} < {_RANK.format("CASE WHEN s1 = '' THEN 'LOW' ELSE s1 END")} AS worse FROM p)
    SELECT file_path, CASE WHEN worse THEN 'm' ELSE 's' END || doc_id AS id, CASE WHEN worse THEN s2 ELSE s1 END AS severity, 'static-analysis' AS source, CASE WHEN worse THEN 'theirs' WHEN r1 = '' THEN 'theirs' ELSE r1 END AS recommendation,
        CASE WHEN worse THEN CASE WHEN t2 = 'confirmed' THEN t2 WHEN t1 IN ('confirmed', 'escalated') THEN t1 ELSE t2 END ELSE CASE WHEN t1 IN ('confirmed', 'escalated') THEN t1 WHEN t2 = 'confirmed' THEN t2 ELSE t1 END END AS triage, 'because' AS triage_note FROM q""")
def merged_findings(spark, sf_dir):
    """A finding of the scan and one of a reviewer at each place: the worse one wins, and takes over what it lacks."""
    d = F.col("doc_id")
    triage = F.element_at(F.array(*[F.lit(t) for t in _TRIAGE]), (d % 5 + 1).cast("int"))
    base = texts(spark, sf_dir).select("doc_id", "file_path", F.lit(3).alias("line"))
    scanned = base.select("*", F.concat(F.lit("s"), d.cast("string")).alias("id"), F.lit("A rule").alias("name"), pick(_SEVERITY, d).alias("severity"), F.lit("static-analysis").alias("source"), triage.alias("triage"), F.when(d % 3 == 0, "").otherwise("own").alias("recommendation"), F.lit(None).cast("string").alias("triage_note"), F.lit(1).alias("ord"))
    judged = base.select("*", F.concat(F.lit("m"), d.cast("string")).alias("id"), F.lit("Another").alias("name"), pick(_SEVERITY, d * 3 + 1).alias("severity"), F.lit("model-review").alias("source"), F.when(d % 2 == 0, "confirmed").otherwise("unverified").alias("triage"), F.lit("theirs").alias("recommendation"), F.lit("because").alias("triage_note"), F.lit(2).alias("ord"))
    both = scanned.unionByName(judged).withColumns({"snippet": F.lit(""), "description": F.lit("")})
    return findings.dedupe(both).select("file_path", "id", "severity", "source", "recommendation", "triage", "triage_note")


@query(f"""WITH {_FOUND}, t AS (SELECT * FROM found WHERE triage IS NULL OR triage <> 'dismissed' QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ord) <= 24), f AS (SELECT id, 'fix ' || doc_id AS advice, doc_id % 2 = 0 AS breaking FROM t WHERE doc_id % 4 <> 0)
    SELECT a.id, coalesce(advice, recommendation) AS recommendation, CASE WHEN advice IS NOT NULL THEN 'small' END AS fix_effort, CAST(breaking AS VARCHAR) AS fix_breaking_change FROM found a LEFT JOIN f USING (id)""")
def remediated_findings(spark, sf_dir):
    """The first 24 live findings of a repository go out in batches of eight; answers come back as JSON, some without advice."""
    f, d = found(spark, sf_dir), F.col("doc_id")
    targets = findings.batches(findings.renumber(findings.fix_targets(f, ["repo_id"]), ["repo_id"]), review.FIX_BATCH)
    fix = F.struct("id", F.when(d % 4 != 0, F.concat(F.lit("fix "), d.cast("string"))).otherwise(" ").alias("recommendation"), F.lit(" Small").alias("effort"), (d % 2 == 0).alias("breaking_change"))
    answers = targets.groupBy("repo_id", "batch_id").agg(F.to_json(F.collect_list(fix)).alias("x")).select(F.concat_ws("/", F.lit("fixes"), "repo_id", F.col("batch_id").cast("string")).alias("request_id"), F.concat(F.lit('{"fixes": '), "x", F.lit("}")).alias("answer"))
    return review.remediate(f, texts(spark, sf_dir), answers, ["repo_id"]).select("id", "recommendation", "fix_effort", F.col("fix_breaking_change").cast("string").alias("fix_breaking_change"))


@query(f"""WITH {_FOUND}, l AS (SELECT id, f.line, string_split(regexp_replace(regexp_replace(content, '\\r\\n?', chr(10), 'g'), '\\n$', ''), chr(10)) AS ls FROM found f JOIN files USING (file_path)),
    n AS (SELECT id, line, ls, greatest(1, line - 4) AS a, least(len(ls), line + 4) AS b FROM l)
    SELECT id, md5(CASE WHEN line = 0 THEN '' ELSE array_to_string(list_transform(range(a, b + 1), lambda k: k || ': ' || ls[k]), chr(10)) END) AS region FROM n""")
def finding_regions(spark, sf_dir):
    return findings.region(found(spark, sf_dir), texts(spark, sf_dir), 4, numbered=True).select("id", F.md5("region").alias("region"))


@query(f"WITH {_FOUND} SELECT id FROM found WHERE file_path = (SELECT min(file_path) FROM found WHERE line = 2) AND line = 2 ORDER BY ord LIMIT 1")
def finding_lookup(spark, sf_dir):
    f = found(spark, sf_dir)
    path = f.filter("line = 2").agg(F.min("file_path")).first()[0]
    return findings.find(f, "no such id", path or "", 2).select("id")


_LIVE = "(triage IS NULL OR triage <> 'dismissed')"
_GROUNDED = f"{_FOUND}, g AS (SELECT * FROM found WHERE {_LIVE} AND (rule IN ('weak_hash', 'debug_mode') OR triage IN ('confirmed', 'escalated')) QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY ord) <= 3)"
_QUERY = "CASE rule WHEN 'weak_hash' THEN '" + review.GUIDANCE["weak_hash"] + "' WHEN 'debug_mode' THEN '" + review.GUIDANCE["debug_mode"] + "' ELSE name || ' remediation OWASP' END"


@query(f"""WITH {_GROUNDED}, q AS (SELECT repo_id, id, {_QUERY} AS query FROM g) SELECT repo_id, id, query, CASE WHEN query LIKE 'name 1%' THEN 'open ' ELSE 'own ' END || query AS answer, CASE WHEN query LIKE 'name 1%' THEN 'z' ELSE 'a,b,c' END AS sources FROM q WHERE query NOT LIKE 'name 2%'""")
def grounded_findings(spark, sf_dir):
    """Three searches a repository; one that finds nothing in the listed domains is made again openly, one that fails grounds nothing."""
    f = found(spark, sf_dir)
    asked = f.select(review.rule_query(F.col("rule"), F.col("name")).alias("query")).distinct()
    empty, failed = F.startswith("query", F.lit("name 1")), F.startswith("query", F.lit("name 2"))
    own = asked.filter(~failed).select("query", F.lit(True).alias("restricted"), F.concat(F.lit("own "), "query").alias("answer"), F.when(empty, F.array().cast("array<string>")).otherwise(F.array(*map(F.lit, "abcd"))).alias("sources"))
    free = asked.select("query", F.lit(False).alias("restricted"), F.concat(F.lit("open "), "query").alias("answer"), F.array(F.lit("z")).alias("sources"))
    return review.ground(f, own.unionByName(free), ["repo_id"]).select("repo_id", "id", "query", "answer", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {_GROUNDED} SELECT f.id, CASE WHEN g.id IS NOT NULL THEN 'see ' || f.id END AS reference FROM found f LEFT JOIN g USING (id)")
def referenced_findings(spark, sf_dir):
    f = found(spark, sf_dir)
    some = findings.budgeted(findings.groundable(f, ["weak_hash", "debug_mode"]), [F.col("ord")], 3, ["repo_id"]).filter("within").select("id", F.concat(F.lit("see "), "id").alias("reference"))
    return findings.apply_references(f, some.unionByName(some)).select("id", "reference")


# ---- dependencies

_SPECS = ["==1.2.3", "^1.0", ">=2,<3", "~= 1.4.2", "latest", "v1.2", "1.0.0-beta", "[1.0]", "", " 1.5 ; python>3", "*", "^>=1", "@2.0 || 3"]
_TEXTS = [
    "The latest version of it is 3.1.0. Older ones remain.", "pkg 2.5.1 is the current release", "pkg is affected by CVE-2024-12345 and cve-2023-0001, fixed in 1.9. This is critical.", "Nothing is known.", "1.0", "Exploited in the wild: moderate denial of service. Upgrade to version 4.2.1",
    "Some words. Security fixes came. CVE-2020-1111", "", "the newest is 1.2.3",
]
_BARE = "trim(ltrim(trim({}), '{}'))"


def _pinned_sql(spec: str) -> str:
    out = f"trim({spec})"
    for o in X.OPERATORS:
        out = f"trim(ltrim({out}, '{o}'))"
    return f"(SELECT CASE WHEN regexp_matches(v, '^v?\\d+(?:\\.\\d+)*[A-Za-z0-9.\\-+]*$') THEN v ELSE '' END FROM (SELECT trim(trim(regexp_extract({out}, '^([^;, ]*)', 1)), '[]()') AS v))"


_PARSED = "string_split(nullif(regexp_extract({}, '^\\s*v?(\\d+(?:\\.\\d+)*)', 1), ''), '.')"
_LATEST = f"coalesce(string_split(nullif(regexp_extract({{0}}, '(?i)(?:latest|current|newest|most recent)[^.\\n]{{{{0,40}}}}?(\\d+(?:\\.\\d+)+)', 1), ''), '.'), string_split(nullif(regexp_extract({{0}}, '(?i)(\\d+(?:\\.\\d+)+)[^.\\n]{{{{0,24}}}}?(?:is|as)\\s+the\\s+(?:latest|current|newest)', 1), ''), '.'), {_PARSED.replace('{}', '{0}')})"
_INTS = "list_transform({}, lambda x: CAST(x AS INTEGER))"
_LEVEL = "CASE WHEN regexp_matches(lower({0}), 'critical|remote code execution|rce|arbitrary code') THEN 'CRITICAL' WHEN regexp_matches(lower({0}), 'high severity|high-severity|privilege escalation|sql injection|command injection') THEN 'HIGH' WHEN regexp_matches(lower({0}), 'moderate|medium|denial of service|information disclosure|xss|csrf') THEN 'MEDIUM' WHEN regexp_matches(lower({0}), 'low severity|low-severity|minor|information leak') THEN 'LOW' ELSE 'UNKNOWN' END"
_SENTENCES = "list_filter(list_transform(regexp_split_to_array(regexp_replace({}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"


@query(f"""WITH p AS (SELECT p_partkey, {pick_sql(_SPECS, 'p_partkey')} AS spec, {pick_sql(_TEXTS, 'p_partkey // 3')} AS t FROM part),
    q AS (SELECT *, {_pinned_sql('spec')} AS pinned, {_INTS.format(_LATEST.format('t'))} AS latest, {_SENTENCES.format('t')} AS said FROM p),
    r AS (SELECT *, {_INTS.format(_PARSED.format('pinned'))} AS own, list_filter(said, lambda s: regexp_matches(s, '(?i)^(?:vulnerab\\w*|affected|exploit\\w*|security|remote code|outdated|deprecated)') OR regexp_matches(s, '(?i)CVE-\\d{{4}}-\\d{{4,7}}')) AS telling FROM q)
    SELECT p_partkey, pinned, array_to_string(own, '.') AS parsed, array_to_string(latest, '.') AS latest, {_LEVEL.format('t')} AS severity, substr(coalesce(telling[1], said[1], ''), 1, 300) AS evidence,
        array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i)CVE-\\d{{4}}-\\d{{4,7}}'), lambda c: upper(c)))), ',') AS cves, regexp_extract(t, '(?i)(?:fixed in|patched in|fixed from|upgrade to|update to|remedied in)\\D{{0,24}}(\\d+(?:\\.\\d+){{1,3}})', 1) AS fixed_in,
        CASE WHEN own IS NULL OR latest IS NULL THEN NULL WHEN own[1] <> latest[1] THEN (latest[1] - own[1]) || ' major release(s) behind' WHEN greatest(len(own), len(latest)) > 1 AND coalesce(own[2], 0) <> coalesce(latest[2], 0) THEN (coalesce(latest[2], 0) - coalesce(own[2], 0)) || ' minor release(s) behind'
            ELSE greatest(0, coalesce(latest[greatest(len(own), len(latest))], 0) - coalesce(own[greatest(len(own), len(latest))], 0)) || ' patch release(s) behind' END AS behind FROM r""")
def version_facts(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", pick(_SPECS, F.col("p_partkey")).alias("spec"), pick(_TEXTS, F.floor(F.col("p_partkey") / 3)).alias("t"))
    dotted = lambda v: F.array_join(F.transform(v, lambda x: x.cast("string")), ".")
    q = p.withColumns({"pinned": X.pinned_version(F.col("spec")), "latest": X.latest_version(F.col("t"))}).withColumn("own", X.parse_version(F.col("pinned")))
    return q.select(
        "p_partkey", "pinned", dotted(F.col("own")).alias("parsed"), dotted(F.col("latest")).alias("latest"), X.severity_from_text(F.col("t")).alias("severity"), X.evidence_line(F.col("t")).alias("evidence"), F.array_join(X.cves(F.col("t")), ",").alias("cves"), X.fixed_in(F.col("t")).alias("fixed_in"),
        F.when(F.col("own").isNotNull() & F.col("latest").isNotNull(), X.distance_behind(F.col("own"), F.col("latest"))).alias("behind"),
    )


_ECOSYSTEMS = ["npm", "pypi", "go", "elsewhere"]
_LABEL = "CASE ecosystem WHEN 'npm' THEN 'npm' WHEN 'pypi' THEN 'PyPI' WHEN 'go' THEN 'Go modules' ELSE 'package registry' END"
_ASKED = f"""d AS (SELECT 'r' || p_partkey % 30 AS repo_id, 'Pkg' || p_partkey AS name, {pick_sql(_ECOSYSTEMS, 'p_partkey // 30')} AS ecosystem, CASE WHEN p_partkey % 4 = 3 THEN 'latest' ELSE '^1.' || p_partkey % 4 END AS version, p_partkey AS ord FROM part),
    n AS (SELECT *, CASE WHEN version = 'latest' THEN '' ELSE substr(version, 2) END AS pinned, row_number() OVER (PARTITION BY repo_id ORDER BY ord) AS k FROM d),
    a AS (SELECT *, 'advisory' AS kind, CASE WHEN k <= 8 THEN concat_ws(' ', name, nullif(pinned, ''), {_LABEL}, 'security advisory CVE known vulnerabilities') END AS query FROM n UNION ALL
        SELECT *, 'version', 'latest stable released version of the ' || name || ' package on ' || {_LABEL} || ' 2026' FROM n WHERE k <= 5)"""
_CHECKED = f"""{_ASKED}, s AS (SELECT *, CASE WHEN query IS NULL OR ord % 7 = 0 THEN NULL WHEN kind = 'advisory' THEN CASE ord % 3 WHEN 0 THEN lower(name) || ' has CVE-2024-' || (10000 + ord) || ', a minor flaw fixed in 1.9' WHEN 1 THEN 'CVE-2024-9999 is elsewhere' ELSE 'nothing' END
        ELSE CASE ord % 3 WHEN 0 THEN 'no number' WHEN 1 THEN 'the latest version is 1.2' ELSE 'the latest version is 1.0.1' END END AS answer FROM a),
    c AS (SELECT *, CASE WHEN query IS NULL OR answer IS NULL THEN 'unverified' WHEN kind = 'advisory' THEN CASE WHEN ord % 3 = 0 THEN 'vulnerable' ELSE 'checked' END
        WHEN pinned = '' OR ord % 3 = 0 THEN 'unverified' WHEN (ord % 3 = 1 AND pinned < '1.2') OR (ord % 3 = 2 AND pinned < '1.0.1') THEN 'outdated' ELSE 'checked' END AS status FROM s)"""


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    deps = table(spark, sf_dir, "part").select(F.concat(F.lit("r"), (p % 30).cast("string")).alias("repo_id"), F.concat(F.lit("Pkg"), p.cast("string")).alias("name"), pick(_ECOSYSTEMS, F.floor(p / 30)).alias("ecosystem"), F.when(p % 4 == 3, "latest").otherwise(F.concat(F.lit("^1."), (p % 4).cast("string"))).alias("version"), F.lit("m").alias("declared_in"), p.alias("ord"))
    asked, n = review.with_budget(deps, ["repo_id"]), F.col("ord")
    advisory = F.when(n % 3 == 0, F.concat(F.lower("name"), F.lit(" has CVE-2024-"), (n + 10000).cast("string"), F.lit(", a minor flaw fixed in 1.9"))).when(n % 3 == 1, "CVE-2024-9999 is elsewhere").otherwise("nothing")
    version = F.when(n % 3 == 0, "no number").when(n % 3 == 1, "the latest version is 1.2").otherwise("the latest version is 1.0.1")
    both = F.array(F.struct(F.col("advisory_query").alias("query"), advisory.alias("answer")), F.struct(F.col("version_query").alias("query"), version.alias("answer")))
    answers = asked.filter("ord % 7 <> 0").select(F.explode(both).alias("x")).select("x.*", F.lit("").alias("snippets")).filter("query is not null")
    return review.verify(deps, answers, ["repo_id"])


@query(f"""WITH {_CHECKED} SELECT repo_id, name, kind, status, query, CASE WHEN query IS NULL THEN 'not checked: per-run search budget reached' WHEN answer IS NULL THEN kind || ' search failed' WHEN status = 'unverified' THEN 'no parsable version in the search answer' END AS reason,
    CASE WHEN status = 'vulnerable' THEN 'LOW' END AS severity, CASE WHEN status = 'vulnerable' THEN 'CVE-2024-' || (10000 + ord) END AS cves, CASE WHEN status = 'vulnerable' THEN '>= 1.9' END AS fixed_in,
    CASE WHEN status = 'outdated' THEN CASE WHEN ord % 3 = 1 THEN (2 - CAST(ord % 4 AS INTEGER)) || ' minor release(s) behind' ELSE '1 patch release(s) behind' END END AS behind_by FROM c""")
def verified_dependencies(spark, sf_dir):
    """Eight searches for advisories and five for versions in each repository; some fail, some name another package."""
    return _verified(spark, sf_dir).select("repo_id", "name", "kind", "status", "query", "reason", "severity", "cves", "fixed_in", "behind_by")


@query(f"""WITH {_CHECKED} SELECT repo_id, count(DISTINCT ecosystem || lower(name)) AS declared, count_if(query IS NOT NULL AND answer IS NOT NULL) AS queries_run, count_if(status = 'vulnerable') AS vulnerable, count_if(status = 'outdated') AS outdated,
    count_if(status = 'checked') AS checked, count_if(status = 'unverified') AS unverified FROM c GROUP BY repo_id""")
def verification_counts(spark, sf_dir):
    return review.verification_counts(_verified(spark, sf_dir), ["repo_id"])


# ---- architecture

_SHAPES = 4


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN '' ELSE 'about ' || doc_id END AS summary, CASE doc_id % 4 WHEN 0 THEN 'layered' ELSE '' END AS pattern, CASE doc_id % 4 WHEN 0 THEN 'core,edge' WHEN 1 THEN 'only' WHEN 2 THEN 'b0,b1,b2,b3,b4,b5,b6,b7' ELSE '' END AS layers,
    CASE doc_id % 4 WHEN 0 THEN 'a.py' WHEN 1 THEN 'where.py' ELSE '' END AS entries, CASE doc_id % 4 WHEN 0 THEN 'x,y' ELSE '' END AS flow, doc_id % 4 <> 3 AS extracted FROM documents""")
def cleaned_architectures(spark, sf_dir):
    """Answers by the documented names, by others inside a wrapper, with too many parts, and without any."""
    d = F.col("doc_id")
    about = F.concat(F.lit("about "), d.cast("string"))
    raw = (
        F.when(d % 4 == 0, F.concat(F.lit('{"summary": "'), about, F.lit('", "pattern": "layered", "layers": [{"name": "core", "files": ["a"]}, "edge", 3], "entry_points": [{"file_path": "a.py", "role": "r"}], "data_flow": ["x", " ", "y"], "risks": []}')))
        .when(d % 4 == 1, F.concat(F.lit('{"repo": {}, "architecture": {"overview": "'), about, F.lit('", "components": ["only"], "entrypoints": [{"location": "where.py", "description": "starts"}]}}')))
        .when(d % 4 == 2, F.concat(F.lit('{"description": "'), about, F.lit('", "boundaries": ["b0","b1","b2","b3","b4","b5","b6","b7","b8","b9"]}')))
        .otherwise('{"note": "nothing"}')
    )
    facts = table(spark, sf_dir, "documents").select("doc_id", F.lit("{}").alias("facts"))
    answers = table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("architecture"), d.cast("string")).alias("request_id"), raw.alias("answer"))
    made = review.architecture(facts, answers, ["doc_id"]).select("doc_id", "architecture.*")
    of = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",")
    return made.select("doc_id", "summary", "pattern", of("layers", "name").alias("layers"), of("entry_points", "file_path").alias("entries"), F.array_join("data_flow", ",").alias("flow"), "extracted")


# ---- context

_TREE = "['README.md', 'main.py', 'src/auth/login.py', 'src/auth/token.py', 'docs/LICENSE', 'index.ts', 'x/app.py', 'Makefile', 'src/login_view.ts', 'y/main.go', 'CHANGELOG.md', 'src/util.py']"
_TREE_LIST = [x.strip("' ") for x in _TREE.strip("[]").split(",")]
_TREES = f"tree AS (SELECT DISTINCT 'r' || doc_id % 9 AS repo_id, {_TREE}[CAST(doc_id * 5 % 12 AS BIGINT) + 1] AS file_path, CAST(doc_id AS BIGINT) AS ord FROM documents)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), (d % 9).cast("string")).alias("repo_id"), pick(_TREE_LIST, d * 5).alias("file_path"), d.alias("ord"), F.col("text").alias("content"), F.lit("python").alias("language"), (d % 17).cast("int").alias("complexity"), F.col("n_chars").alias("loc"))


@query(f"WITH {_TREES}, f AS (SELECT repo_id, file_path, min(ord) AS ord FROM tree WHERE lower(split_part(file_path, '/', -1)) IN ('main.py', 'index.ts', 'app.py', 'main.go') GROUP BY ALL) SELECT repo_id, file_path, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY ord) AS INTEGER) AS place FROM f QUALIFY place <= 12")
def entry_points(spark, sf_dir):
    return context.entry_points(tree(spark, sf_dir), ["repo_id"])


@query(f"""WITH {_TREES}, p AS (SELECT *, CASE lower(split_part(file_path, '/', -1)) WHEN 'readme.md' THEN 100 WHEN 'license' THEN 70 WHEN 'makefile' THEN 60 WHEN 'changelog.md' THEN 40 END AS priority FROM tree)
    SELECT p.repo_id, file_path, priority, md5(substr(d.text, 1, 4000)) AS head, CAST(row_number() OVER (PARTITION BY p.repo_id ORDER BY priority DESC, ord) AS INTEGER) AS place FROM p JOIN documents d ON doc_id = ord WHERE priority IS NOT NULL""")
def context_documents(spark, sf_dir):
    return context.documents(tree(spark, sf_dir), ["repo_id"]).select("repo_id", "file_path", "priority", F.md5("content").alias("head"), "place")


@query("SELECT DISTINCT doc_id % 9 AS repo, unnest(['e' || doc_id % 4, 'x' || doc_id % 3, 'e' || doc_id % 3]) AS file_path FROM documents")
def structural_files(spark, sf_dir):
    d = F.col("doc_id")
    one = lambda p, k: F.array(F.struct(F.concat(F.lit(p), (d % k).cast("string")).alias("file_path")), F.struct(F.lit("").alias("file_path")))
    return context.structural(table(spark, sf_dir, "documents").select((d % 9).alias("repo"), one("e", 4).alias("entry_points"), one("x", 3).alias("extension_points"), one("e", 3).alias("risks")), ["repo"])


_NARROW = "read src/auth/login.py"


@query(f"""WITH {_TREES}, f AS (SELECT repo_id, file_path, min(ord) AS ord FROM tree GROUP BY ALL), s AS (SELECT *, list_filter(regexp_split_to_array(lower(file_path), '[/\\\\._-]+'), lambda x: x <> '') AS parts, regexp_replace(lower(split_part(file_path, '/', -1)), '\\.[^.]*$', '') AS stem FROM f),
    t AS (SELECT * FROM s, (SELECT unnest(['src', 'auth', 'login.py']) AS term)), p AS (SELECT repo_id, file_path, ord, sum(CASE WHEN list_contains(parts, term) THEN CASE WHEN term = stem THEN 8 ELSE 5 END
        WHEN len(list_filter(parts, lambda x: length(x) >= 4 AND length(term) >= 4 AND (starts_with(x, term) OR starts_with(term, x)))) > 0 THEN 3 WHEN length(term) >= 5 AND contains(lower(split_part(file_path, '/', -1)), term) THEN 4 ELSE 0 END) AS relevance FROM t GROUP BY ALL),
    c AS (SELECT *, relevance > 0 AS chosen, max(relevance > 0) OVER (PARTITION BY repo_id) AS any_ FROM p)
    SELECT repo_id, file_path, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY chosen DESC, CASE WHEN chosen THEN -relevance END, CASE WHEN chosen THEN file_path END, ord) AS INTEGER) AS place FROM c WHERE chosen OR NOT any_ QUALIFY place <= 6""")
def selected_context(spark, sf_dir):
    """A narrow question takes six files by relevance, or the first where none is relevant."""
    return context.select(tree(spark, sf_dir), _NARROW, ["repo_id"]).select("repo_id", "file_path", "place")


@query()
def gathered_context(spark, sf_dir):
    """Selected files and their neighbours under a budget; each choice depends on those before, so tests hold it against a plain walk."""
    files = tree(spark, sf_dir).groupBy("repo_id", "file_path").agg(F.min("ord").alias("ord"), F.min_by("content", "ord").alias("content"))
    edges = files.alias("a").join(files.alias("b"), (F.col("a.repo_id") == F.col("b.repo_id")) & (F.col("b.ord") == F.col("a.ord") + 9)).select("a.repo_id", F.col("a.file_path").alias("source"), F.col("b.file_path").alias("target"))
    chosen = context.select(files, "give me an overview of login", ["repo_id"])
    return context.gather(chosen, files, edges, True).select("repo_id", "place", "role", "file_path", F.length("text").alias("chars"))


@query("""WITH s AS (SELECT DISTINCT doc_id // 100 AS conv, 'p' || doc_id % 40 AS file_path, 0 AS k, doc_id AS p FROM documents UNION ALL SELECT doc_id // 100, 'p' || doc_id % 60, 1, doc_id FROM documents),
    f AS (SELECT conv, file_path, min({'k': k, 'p': p}) AS first FROM s GROUP BY ALL) SELECT conv, file_path, CAST(row_number() OVER (PARTITION BY conv ORDER BY first) AS INTEGER) AS place FROM f""")
def answer_sources(spark, sf_dir):
    """The sources of each conversation, a hundred documents each."""
    d = F.col("doc_id")
    some = table(spark, sf_dir, "documents").select(F.floor(d / 100).alias("conv"), "doc_id")
    return context.sources(some.select("conv", F.concat(F.lit("p"), (d % 40).cast("string")).alias("file_path"), d.alias("place")), some.select("conv", F.concat(F.lit("p"), (d % 60).cast("string")).alias("file_path"), d.alias("seq")), ["conv"])


@query("""WITH d AS (SELECT 'r' || doc_id % 9 AS repo_id, doc_id, n_chars FROM documents), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY repo_id) AS c FROM d),
    f AS (SELECT repo_id, max(c) AS c, string_agg('- f' || doc_id || ' (python, complexity ' || doc_id % 17 || ', ' || n_chars || ' lines)', chr(10) ORDER BY r) FILTER (WHERE r <= 12) AS shape FROM n GROUP BY repo_id),
    m AS (SELECT repo_id, doc_id % 6 AS file, doc_id, row_number() OVER (PARTITION BY repo_id, doc_id % 6 ORDER BY doc_id) AS r FROM d),
    g AS (SELECT repo_id, file, substr(string_agg('p' || doc_id || '1.' || doc_id % 3, ', ' ORDER BY r) FILTER (WHERE r <= 40), 1, 2000) AS names FROM m GROUP BY ALL), h AS (SELECT repo_id, string_agg('Dependencies from m' || file || ' (npm): ' || names, chr(10) ORDER BY file) FILTER (WHERE k <= 4) AS deps FROM (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY file) AS k FROM g) GROUP BY repo_id)
    SELECT repo_id, md5(concat_ws(chr(10), 'Repository URL: u/' || repo_id, 'Commit analysed: 0123456789ab', 'Total files analysed: ' || c, 'Summary: about ' || repo_id, deps, chr(10) || 'Repository structure:' || chr(10) || shape)) AS context FROM f JOIN h USING (repo_id)""")
def general_context(spark, sf_dir):
    d = F.col("doc_id")
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), (d % 9).cast("string")).alias("repo_id"), F.concat(F.lit("f"), d.cast("string")).alias("file_path"), F.lit("python").alias("language"), (d % 17).cast("int").alias("complexity"), F.col("n_chars").alias("loc"), d.alias("ord"))
    deps = files.select("repo_id", F.concat(F.lit("m"), (F.col("ord") % 6).cast("string")).alias("file_path"), F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), F.col("ord").cast("string")).alias("name"), F.concat(F.lit("1."), (F.col("ord") % 3).cast("string")).alias("version"), (F.col("ord") % 6).alias("file_ord"), "ord")
    shots = files.select("repo_id").distinct().select("repo_id", F.concat(F.lit("u/"), "repo_id").alias("repo_url"), F.lit("0123456789abcdef").alias("head_sha"), F.lit(None).cast("string").alias("pattern"), F.concat(F.lit("about "), "repo_id").alias("summary"))
    none = files.limit(0).select("repo_id", "file_path", F.lit("").alias("content"), F.lit(0).alias("place"))
    return context.general(shots, files, deps, none, ["repo_id"]).select("repo_id", F.md5("context").alias("context"))


@query("""WITH c AS (SELECT conv_id, conv_id % 200 AS k, conv_id % 4 AS kind, arg_min(text, turn) AS text FROM conversations GROUP BY conv_id)
    SELECT conv_id, CAST([1, 2, 3, 7][CAST(kind + 1 AS BIGINT)] AS INTEGER) AS rounds, CAST([0, 1, 3, 6][CAST(kind + 1 AS BIGINT)] AS INTEGER) AS n_records, CAST(CASE kind WHEN 0 THEN 0 WHEN 1 THEN CAST(coalesce(d.text, '') = '' AS INTEGER) WHEN 2 THEN 1 ELSE 6 END AS INTEGER) AS n_errors,
        CASE WHEN kind = 1 THEN 'd' || k || '.txt' ELSE '' END AS read, md5(CASE WHEN kind = 3 THEN 'All 6 rounds of look-ups were used without an answer.' ELSE coalesce(c.text, '') END) AS answer FROM c LEFT JOIN documents d ON d.doc_id = k""")
def held_conversations(spark, sf_dir):
    """Every conversation of the table, held at once: answered as it stands, after a look-up, after three, or never."""
    d, conv = F.col("doc_id"), F.col("conv_id")
    docs = table(spark, sf_dir, "documents")
    files_ = docs.select(F.concat(F.lit("r"), (d % 13).cast("string")).alias("repo_id"), F.concat(F.lit("d"), d.cast("string"), F.lit(".txt")).alias("file_path"), F.col("text").alias("content"), d.alias("ord"))
    links = files_.select("repo_id", F.col("file_path").alias("source"), F.concat(F.lit("d"), (F.col("ord") + 13).cast("string"), F.lit(".txt")).alias("target"))
    first = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    kind, path = conv % 4, F.concat(F.lit('{"path": "d'), (conv % 200).cast("string"), F.lit('.txt"}'))
    call = lambda name, arguments: F.struct(F.lit(name).alias("name"), arguments.alias("arguments"))
    turn = lambda number, text, *calls: F.struct(F.lit(number).alias("round"), text.alias("text"), (F.array(*calls) if calls else F.array()).cast(conversations.CALLS).alias("calls"))
    text, quiet = F.col("text"), F.lit("")
    script = (
        F.when(kind == 0, F.array(turn(1, text)))
        .when(kind == 1, F.array(turn(1, quiet, call("read_file", path)), turn(2, text)))
        .when(kind == 2, F.array(turn(1, quiet, call("search_code", F.lit('{"query": "the", "max_results": 3}')), call("guess", F.lit("{}"))), turn(2, quiet, call("list_dependencies_of_file", path)), turn(3, text)))
        .otherwise(F.array(*[turn(n, quiet, call("read_file", F.lit("none"))) for n in range(1, 7)], turn(7, F.lit('read_file({"path": "x"})'))))
    )
    turns = first.select("conv_id", F.explode(script).alias("x")).select("conv_id", "x.*")
    asked = first.select("conv_id", F.concat(F.lit("r"), ((conv % 200) % 13).cast("string")).alias("repo_id"), F.array(F.struct(F.lit("user").alias("role"), F.coalesce("text", quiet).alias("content"))).alias("said"))
    out = conversations.converse(asked, files_, links, conversations.scripted(turns))
    errors = F.size(F.filter("records", lambda r: F.startswith(r["result_preview"], F.lit('{"error"'))))
    return out.select("conv_id", "rounds", F.size("records").alias("n_records"), errors.alias("n_errors"), F.array_join("read", ",").alias("read"), F.md5("answer").alias("answer"))


# ---- patches

_PATCHED = "lines AS (SELECT doc_id, doc_id % 10 + 2 AS k, list_transform(range(1, 15), lambda j: 'l' || j || '-' || doc_id) AS ls FROM documents)"


@query(f"""WITH {_PATCHED}, h AS (SELECT *, greatest(1, k - 3) AS a, least(14, k + 3) AS b FROM lines)
    SELECT doc_id, true AS applies, '' AS reason, md5('--- a/f' || doc_id || chr(10) || '+++ b/f' || doc_id || chr(10) || '@@ -' || a || ',' || (b - a + 1) || ' +' || a || ',' || (b - a + 1) || ' @@' || chr(10)
        || array_to_string(list_transform(range(a, b + 1), lambda j: CASE WHEN j = k THEN '-' || ls[j] || chr(10) || '+changed ' || doc_id ELSE ' ' || ls[j] END), chr(10)) || chr(10)) AS diff FROM h
    UNION ALL SELECT doc_id, false, 'unsafe path', md5('--- a/../f' || chr(10) || '+++ b/../f' || chr(10) || '@@ -1 +1 @@' || chr(10) || '-a' || chr(10) || '+b') FROM documents UNION ALL SELECT doc_id, false, 'no usable diff', md5('') FROM documents""")
def checked_patches(spark, sf_dir):
    """A fenced diff with wrong counts and places, anchored anew; one that leaves the repository; and one that is no diff."""
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    k = (d % 10 + 2).cast("int")
    line = lambda j: F.concat(F.lit("l"), j.cast("string"), F.lit("-"), s)
    source = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(14)), line), "\n")
    good = F.concat(F.lit("Sure:\n```diff\n--- a/f"), s, F.lit("\n+++ b/f"), s, F.lit("\n@@ -1,9 +1,7 @@\n "), line(k - 1), F.lit("\n-"), line(k), F.lit("\n+changed "), s, F.lit("\n "), line(k + 1), F.lit("\n```"))
    diffs = F.array(good, F.lit("--- a/../f\n+++ b/../f\n@@ -1 +1 @@\n-a\n+b"), F.lit("no diff at all"))
    base = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), s).alias("file_path"), source.alias("content"), F.explode(diffs).alias("diff"))
    out = patches.check(base.select("file_path", "diff"), base.select("file_path", "content").distinct())
    return out.select(F.substring("file_path", 2, 20).cast("bigint").alias("doc_id"), "applies", "reason", F.md5("diff").alias("diff"))


@query(f"""WITH {_PATCHED}, h AS (SELECT *, greatest(1, k - 3) AS a, least(14, k + 3) AS b FROM lines)
    SELECT doc_id, true AS applies, '' AS reason, md5('--- a/f' || doc_id || chr(10) || '+++ b/f' || doc_id || chr(10) || '@@ -' || a || ',' || (b - a + 1) || ' +' || a || ',' || (b - a + 1) || ' @@' || chr(10)
        || array_to_string(list_transform(range(a, b + 1), lambda j: CASE WHEN j = k THEN '-' || ls[j] || chr(10) || '+changed ' || doc_id ELSE ' ' || ls[j] END), chr(10)) || chr(10)) AS diff FROM h
    UNION ALL SELECT doc_id, true, '', md5('--- a/f' || doc_id || chr(10) || '+++ b/f' || doc_id || chr(10) || '@@ -8,7 +8,6 @@' || chr(10) || ' ' || ls[8] || chr(10) || ' ' || ls[9] || chr(10) || ' ' || ls[10] || chr(10) || '-' || ls[11] || chr(10) || '-' || ls[12] || chr(10) || '-' || ls[13] || chr(10) || '+one' || chr(10) || '+two' || chr(10) || ' ' || ls[14] || chr(10)) FROM lines
    UNION ALL SELECT doc_id, false, 'no usable diff', md5('--- a/f' || doc_id || chr(10) || '+++ b/f' || doc_id || chr(10) || '@@ -3,2 +3,2 @@' || chr(10) || ' l3-' || doc_id || chr(10) || '-absent ' || doc_id || chr(10) || '+x' || chr(10)) FROM documents""")
def reanchored_patches(spark, sf_dir):
    """Diffs whose context is not the file's: the removed lines alone say where they stand; where these are missing the diff stays as it is."""
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    line = lambda j: F.concat(F.lit("l"), F.lit(j).cast("string") if isinstance(j, int) else j.cast("string"), F.lit("-"), s)
    head = F.concat(F.lit("--- a/f"), s, F.lit("\n+++ b/f"), s, F.lit("\n"))
    wrong = F.concat(head, F.lit("@@ -90,9 +1,7 @@\n nothing like it\n \n-"), line((d % 10 + 2).cast("int")), F.lit("\n+changed "), s, F.lit("\n no such line\n"))
    block = F.concat(head, F.lit("@@ -1,4 +1,3 @@\n not here\n-"), line(11), F.lit("\n-"), line(12), F.lit("\n-"), line(13), F.lit("\n+one\n+two\n"))
    absent = F.concat(head, F.lit("@@ -3,2 +3,2 @@\n "), line(3), F.lit("\n-absent "), s, F.lit("\n+x\n"))
    source = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(14)), line), "\n")
    base = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), s).alias("file_path"), source.alias("content"), F.explode(F.array(wrong, block, absent)).alias("diff"))
    out = patches.check(base.select("file_path", "diff"), base.select("file_path", "content").distinct())
    return out.select(F.substring("file_path", 2, 20).cast("bigint").alias("doc_id"), "applies", "reason", F.md5("diff").alias("diff"))


_HEADS = ["--- a/x.py", "+++ b/x.py", "+++ /etc/passwd", "--- a/../x", "+++ b/.git/config", "--- /dev/null", " --- a/../x", "+++ b/a/..b/x", "--- a/x\t2020"]


@query(f"""WITH h AS (SELECT doc_id, [{pick_sql(_HEADS, 'doc_id')}, {pick_sql(_HEADS, 'doc_id // 9 + 1')}] AS hs FROM documents), p AS (SELECT doc_id, regexp_replace(regexp_extract(unnest(list_filter(hs, lambda x: regexp_matches(x, '^(---|\\+\\+\\+) '))), '^(?:---|\\+\\+\\+) ([^\\t\\r]*)', 1), '^[ab]/', '') AS p FROM h)
    SELECT doc_id, coalesce(bool_or(p <> '/dev/null' AND (starts_with(p, '/') OR regexp_matches(p, '(^|/)\\.\\.(/|$)') OR regexp_matches(p, '(^|/)\\.git/'))), false) AS unsafe FROM h LEFT JOIN p USING (doc_id) GROUP BY doc_id""")
def unsafe_diffs(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", X.unsafe_diff(F.concat_ws("\n", pick(_HEADS, d), pick(_HEADS, F.floor(d / 9) + 1))).alias("unsafe"))


_ASKS = ["show me the login", "How does auth work?", "read src/a.py", "overview please", "what is it", "why is src/x slow", "explain the flow", "", "list tests"]
_BROAD = "len(list_filter(" + list_sql(X.BROAD_MARKERS) + ", lambda m: contains(lower(q), m))) > 0 OR (regexp_matches(lower(q), '\\b(what|how|why|where|which|explain|describe|summarise|summarize)\\b') AND NOT regexp_matches(q, '[/._-]'))"


@query(f"""WITH a AS (SELECT conv_id, turn, {pick_sql(_ASKS, 'conv_id + turn')} || ' ' || substr(text, 1, 30) AS q FROM conversations)
    SELECT conv_id, turn, {_BROAD} AS broad, array_to_string(list_filter(list_transform(regexp_split_to_array(lower(q), '[^a-zA-Z0-9_.-]+'), lambda t: trim(t, '._-')), lambda t: length(t) >= 2 AND NOT list_contains({list_sql(sorted(set(X.STOP_WORDS)))}, t)), ' ') AS terms FROM a""")
def asked_questions(spark, sf_dir):
    """Whether a question is about the whole repository, and the terms it leaves (repeats kept here, as the SQL has them)."""
    q = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(pick(_ASKS, F.col("conv_id") + F.col("turn")), F.lit(" "), F.substring("text", 1, 30)).alias("q"))
    return q.select("conv_id", "turn", X.is_broad_query(F.col("q")).alias("broad"), F.array_join(X.query_terms(F.col("q"), distinct=False), " ").alias("terms"))
