"""The registered queries of the engine's own operators, and the SQL that gives the same rows.

The test tables hold no source code, so they stand in for it: documents are files, orders and line items are commits
that touch parts, suppliers refer to parts, labels are verdicts, events are requests.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import churn, digest, findings, graph, hotspots, scan, search
from ..sources import snapshots
from ..streaming import limits
from . import code, languages, passes, results, rules  # noqa: F401  their queries register themselves
from .registry import ORACLE_SQL, QUERIES, found_sql, query, table

__all__ = ["ORACLE_SQL", "QUERIES"]

def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"), F.col("doc_id").alias("ord"))


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit's date and author on each path it touches: orders and their line items."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.col("o_custkey").cast("string").alias("author"), F.to_date("o_orderdate").alias("date"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_partkey").alias("path"), F.col("l_quantity").cast("bigint").alias("added"))
    return li.join(o, "sha")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and the parts they refer to, as often as they do."""
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("source"), F.concat(F.lit("p"), "l_partkey").alias("target"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).distinct()


_FILES = "files AS (SELECT source || '/' || doc_id AS file_path, text AS content, lang AS language, doc_id FROM documents WHERE text IS NOT NULL)"
_LINES = f"{_FILES}, lines AS (SELECT file_path, unnest(string_split(content, chr(10))) AS t, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM files)"
_FOUND = f"{_LINES}, {found_sql('lines', 'file_path')}"


@query(f"WITH {_FOUND} SELECT severity, count(*) AS total, 0 AS dismissed, count(DISTINCT file_path) AS files_affected FROM found GROUP BY severity")
def findings_by_severity(spark, sf_dir):
    return findings.summary(scan.findings(files(spark, sf_dir)))


@query(f"WITH {_FOUND} SELECT rule || ':' || file_path || ':' || line AS id, rule, severity, line, substr(trim(t), 1, 200) AS snippet, round(entropy, 6) AS entropy FROM found")
def located_findings(spark, sf_dir):
    return scan.findings(files(spark, sf_dir)).select("id", "rule", "severity", "line", "snippet", F.round("entropy", 6).alias("entropy"))


_TRIAGED = f"{_FOUND}, judged AS (SELECT f.*, CASE WHEN l.toxic = 0 THEN 'dismissed' WHEN l.toxic = 1 THEN 'confirmed' ELSE 'unreviewed' END AS triage FROM found f LEFT JOIN labels l ON split_part(f.file_path, '/', 2) = CAST(l.doc_id AS VARCHAR))"


@query(f"WITH {_TRIAGED} SELECT triage, count(*) AS n, count_if(triage <> 'dismissed') AS live FROM judged GROUP BY triage")
def triage_join(spark, sf_dir):
    found = scan.findings(files(spark, sf_dir)).withColumn("batch_id", F.lit(0)).withColumn("recommendation", F.lit("")).withColumn("triage", F.lit(None).cast("string")).withColumn("key", F.split_part("file_path", F.lit("/"), F.lit(2)))
    said = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("key"), F.when(F.col("toxic") == 0, "dismiss").otherwise("confirm").alias("verdict"))
    verdicts = found.join(said, "key").select("batch_id", "id", "verdict", F.lit("").alias("severity"), F.lit("").alias("explanation"), F.lit("").alias("recommendation"), F.lit(0).alias("seq"))
    judged = findings.apply_verdicts(found.drop("key"), verdicts)
    return judged.groupBy("triage").agg(F.count(F.lit(1)).alias("n"), F.count_if(findings.survived()).alias("live"))


@query("SELECT l_partkey AS path, count(*) AS commits, count(DISTINCT o_custkey) AS authors, strftime(max(o_orderdate), '%Y-%m-%d') AS last_commit FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey")
def churn_by_file(spark, sf_dir):
    return churn.churn(touched(spark, sf_dir), ["path"]).withColumn("last_commit", F.date_format("last_commit", "yyyy-MM-dd"))


@query("""WITH t AS (SELECT l_partkey AS path, count(*) AS commits FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    n AS (SELECT l_partkey AS path, sum(CAST(l_quantity AS BIGINT)) AS added, sum(l_linenumber) AS removed FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
    SELECT path, commits, CAST(coalesce(added, 0) AS BIGINT) AS added, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(added, 0) + coalesce(removed, 0) AS BIGINT) AS total_changes FROM t LEFT JOIN n USING (path)""")
def line_churn_by_file(spark, sf_dir):
    numstat = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("path"), F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("removed"))
    return churn.line_churn(churn.churn(touched(spark, sf_dir), ["path"]).select("path", "commits"), numstat, ["path"])


@query("SELECT o_custkey AS author, o_orderkey AS sha FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) <= 3")
def recent_commits(spark, sf_dir):
    commits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("author"), F.col("o_orderkey").alias("sha"), F.col("o_orderkey").alias("ord"), F.col("o_orderdate").alias("date"))
    return churn.recent(commits, ["author"], 3).select("author", "sha")


_EDGES = "edges AS (SELECT DISTINCT 's' || l_suppkey AS source, 'p' || l_partkey AS target FROM lineitem)"
_DEGREES = f"{_EDGES}, deg AS (SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT target AS node, 1 AS i, 0 AS o FROM edges UNION ALL SELECT source, 0, 1 FROM edges) GROUP BY node)"


@query(f"WITH {_DEGREES} SELECT * FROM deg")
def graph_degrees(spark, sf_dir):
    return graph.degrees(edges(spark, sf_dir))


@query(f"WITH {_DEGREES} SELECT node, fan_in, fan_out, fan_in + fan_out AS degree FROM deg ORDER BY degree DESC, fan_in DESC, node LIMIT 1")
def graph_hub(spark, sf_dir):
    return graph.hub(edges(spark, sf_dir))


@query(f"WITH {_DEGREES} SELECT node, fan_in, fan_out, round(1 + 7 * fan_in / (SELECT greatest(1, max(fan_in)) FROM deg), 6) AS val, fan_in + fan_out > 0 AS linked FROM deg")
def graph_node_values(spark, sf_dir):
    return graph.node_values(graph.degrees(edges(spark, sf_dir))).withColumn("val", F.round("val", 6))


@query(f"""WITH RECURSIVE {_EDGES}, ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
    starts AS (SELECT DISTINCT source AS start FROM edges WHERE CAST(substr(source, 2) AS BIGINT) % 9 = 1),
    walk(start, node, hop) AS (SELECT start, start, 0 FROM starts UNION SELECT start, b, hop + 1 FROM walk JOIN ways ON node = a WHERE hop < 2)
    SELECT start, node, min(hop) AS hop FROM walk GROUP BY start, node HAVING min(hop) > 0""")
def graph_neighbourhood(spark, sf_dir):
    """Two links around every ninth source, all together."""
    ways = references(spark, sf_dir)
    return graph.neighbourhood(ways, ways.filter(F.substring("source", 2, 20).cast("bigint") % 9 == 1).select(F.col("source").alias("start")).distinct(), 2)


@query(f"WITH {_EDGES} SELECT target AS node, string_agg(source, ',' ORDER BY source) AS dependents FROM edges GROUP BY target")
def graph_dependents(spark, sf_dir):
    return graph.dependents(edges(spark, sf_dir)).filter(F.size("dependents") > 0).select("node", F.array_join("dependents", ",").alias("dependents"))


@query(f"WITH {_EDGES} SELECT (SELECT count(*) FROM part) AS file_count, (SELECT count(*) FROM edges) AS link_count, (SELECT count(DISTINCT p_type) FROM part) AS external_import_count")
def graph_metrics(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return graph.metrics(edges(spark, sf_dir), part.select(F.concat(F.lit("p"), "p_partkey").alias("node")), part.select(F.lit("x").alias("source"), F.col("p_type").alias("specifier")))


_HOT = f"""{_DEGREES}, ch AS (SELECT l_partkey AS path, count(*) AS commits, sum(CAST(l_quantity AS BIGINT)) AS total_changes, count_if(l_returnflag = 'R') AS finding_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
    j AS (SELECT p_partkey AS file_path, p_size AS complexity, CAST(floor(p_retailprice) AS BIGINT) AS loc, coalesce(fan_in, 0) AS fan_in, coalesce(commits, 0) AS commits, coalesce(total_changes, 0) AS total_changes, coalesce(finding_count, 0) AS finding_count
        FROM part LEFT JOIN deg ON node = 'p' || p_partkey LEFT JOIN ch ON path = p_partkey),
    k AS (SELECT *, max(complexity) OVER () AS a, max(commits + total_changes / 20.0) OVER () AS b, max(fan_in) OVER () AS c, max(loc) OVER () AS d, max(finding_count) OVER () AS e FROM j),
    s AS (SELECT *, 0.28 * complexity / a + 0.24 * (commits + total_changes / 20.0) / b + 0.2 * fan_in / c + 0.1 * loc / d + 0.18 * coalesce(finding_count / nullif(e, 0), 0) AS raw FROM k)"""


@query(f"WITH {_HOT} SELECT file_path, round(CASE WHEN finding_count > 0 THEN greatest(raw, 0.18) ELSE raw END, 6) AS score, commits, finding_count, fan_in FROM s WHERE CASE WHEN finding_count > 0 THEN greatest(raw, 0.18) ELSE raw END >= 0.18 ORDER BY round(raw, 9) DESC, file_path LIMIT 8")
def hotspot_ranking(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_path"), F.col("p_size").alias("complexity"), F.floor("p_retailprice").alias("loc"))
    deg = graph.degrees(edges(spark, sf_dir)).filter("node like 'p%'").select(F.substring("node", 2, 20).cast("bigint").alias("file_path"), "fan_in", "fan_out")
    t = touched(spark, sf_dir)
    ch = t.groupBy(F.col("path").alias("file_path")).agg(F.count(F.lit(1)).alias("commits"), F.sum("added").alias("total_changes"))
    found = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("file_path"))
    ranked = hotspots.rank(hotspots.score(hotspots.enrich(parts, deg, ch, found, ["file_path"]), []), [])
    return ranked.select("file_path", F.round("score", 6).alias("score"), "commits", "finding_count", "fan_in")


@query("SELECT lang AS language, count(*) AS files, min(doc_id) AS first FROM documents GROUP BY lang")
def language_counts(spark, sf_dir):
    return search.languages(files(spark, sf_dir))


@query("SELECT doc_id, CAST(CASE WHEN text IS NULL OR text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN text LIKE '%' || chr(10) THEN 0 ELSE 1 END END AS BIGINT) AS loc FROM documents")
def line_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.loc(F.col("text")).cast("bigint").alias("loc"))


@query("SELECT p_partkey, round(abs(-list_sum(list_transform(list_distinct(string_split(p_name, '')), lambda c: (len(list_filter(string_split(p_name, ''), lambda x: x = c)) / length(p_name)) * log2(len(list_filter(string_split(p_name, ''), lambda x: x = c)) / length(p_name))))), 6) AS entropy FROM part")
def value_entropy(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(X.entropy(F.col("p_name")), 6).alias("entropy"))


@query(f"WITH {_LINES} SELECT file_path, line, substr(trim(t), 1, 200) AS text FROM lines WHERE regexp_matches(t, '(?i)licensed? under') ORDER BY file_path, line LIMIT 25")
def code_search(spark, sf_dir):
    return search.search_code(files(spark, sf_dir), "licensed? under", first_chars=None)


@query("SELECT conv_id AS stream_id, md5(string_agg(text, '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id")
def joined_answers(spark, sf_dir):
    pieces = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("stream_id"), F.col("turn").alias("seq"), F.col("text").alias("piece"))
    return search.joined_deltas(pieces).select("stream_id", F.md5("text").alias("text_md5"))


@query("SELECT source || '/' || doc_id AS file_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unknown_files(spark, sf_dir):
    known = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"))
    return search.unknown_paths(files(spark, sf_dir).select("file_path"), known)


@query("SELECT repo_id FROM (SELECT CAST(o_orderkey AS VARCHAR) AS repo_id, o_orderdate AS modified, row_number() OVER (ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR)) AS rn, count(*) OVER () AS n FROM orders) WHERE modified <= TIMESTAMP '1996-01-01' OR rn <= n - 40")
def snapshot_expiry(spark, sf_dir):
    meta = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("repo_id"), F.col("o_orderdate").cast("timestamp").alias("modified"))
    return snapshots.expired(meta, datetime.datetime(1996, 1, 2), 24, 40).select("repo_id")


@query("SELECT doc_id, CAST(row_number() OVER (ORDER BY CASE WHEN quality = 0 THEN 0 ELSE 9 END, doc_id) - 1 AS BIGINT) // 12 AS batch_id FROM labels")
def review_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 0, "CRITICAL").otherwise("NONE").alias("severity"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("file_path"), F.lit(1).alias("line"), F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("repo"))
    return findings.batches(findings.with_place(rows, ["repo"]), 12).select("doc_id", F.col("batch_id").cast("bigint").alias("batch_id"))


@query("""WITH n AS (SELECT source, doc_id, lang, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS r FROM documents)
    SELECT source, count_if(r <= 5) AS within_budget, count_if(r > 5) AS not_checked FROM n GROUP BY source""")
def budgeted_groups(spark, sf_dir):
    rows = findings.budgeted(table(spark, sf_dir, "documents"), [F.desc(F.length("text")), F.col("doc_id")], 5, ["source"])
    return rows.groupBy("source").agg(F.count_if("within").alias("within_budget"), F.count_if(~F.col("within")).alias("not_checked"))


@query()
def admitted_requests(spark, sf_dir):
    """Token buckets of 2 a day over each user's events; sequential, so tests hold it against a plain loop."""
    requests = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id")
    return limits.limit(requests, 2, 86_400)


@query("""SELECT page_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(url, '^https?://[^/]*', ''), '[?#].*$', ''), '/'), lambda x: x <> '' AND x <> '.'), '/') AS path FROM pages""")
def normalised_paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.normalise_path(F.concat(F.lit("./"), F.regexp_replace(F.regexp_replace("url", "^https?://[^/]*", ""), "[?#].*$", ""))).alias("path"))


@query("SELECT substr(sha256('https://github.com/' || lower(p_brand) || '/' || p_partkey), 1, 12) AS repo_id, p_partkey FROM part")
def repository_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").select(X.repo_id(F.concat(F.lit("https://github.com/"), F.lower("p_brand"), F.lit("/"), F.col("p_partkey").cast("string"))).alias("repo_id"), "p_partkey")


_ISSUES = "issues AS (SELECT d.source AS repo, doc_id, CASE WHEN quality = 0 THEN 'HIGH' ELSE 'LOW' END AS severity, CASE WHEN toxic = 1 THEN 'dismissed' ELSE 'confirmed' END AS triage FROM labels JOIN documents d USING (doc_id))"


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as findings in their source."""
    labels = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("repo")), "doc_id")
    return labels.select(
        "repo", F.col("doc_id").alias("ord"), F.when(F.col("quality") == 0, "HIGH").otherwise("LOW").alias("severity"), F.lit("label").alias("rule"), F.col("doc_id").cast("string").alias("file_path"), F.lit(1).alias("line"),
        F.when(F.col("toxic") == 1, "dismissed").otherwise("confirmed").alias("triage"), F.lit("static-analysis").alias("source"), F.lit(None).cast("string").alias("reference"),
    )


@query(f"""WITH {_ISSUES}, f AS (SELECT source AS repo, count(*) AS total_files, CAST(sum(n_chars) AS BIGINT) AS total_loc FROM documents GROUP BY 1),
    i AS (SELECT repo, count(*) AS n, count_if(triage <> 'dismissed' AND severity = 'HIGH') AS high, count_if(triage = 'dismissed') AS gone FROM issues GROUP BY 1)
    SELECT repo, total_files, total_files AS source_files, total_loc, coalesce(n, 0) AS total_vulnerabilities, 0 AS critical_vulnerabilities, coalesce(high, 0) AS high_vulnerabilities, 0 AS medium_vulnerabilities,
        coalesce(n, 0) AS static_findings, 0 AS model_findings, coalesce(gone, 0) AS dismissed_findings, 0 AS grounded_findings FROM f LEFT JOIN i USING (repo)""")
def run_statistics(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.lit(True).alias("is_source"), F.col("n_chars").alias("loc"))
    return digest.run_stats(docs, issues(spark, sf_dir), ["repo"])


@query("""WITH c AS (SELECT source AS repo, CASE WHEN lang = 'en' THEN 'python' ELSE lang END AS language, count(*) AS n, min(doc_id) AS seen FROM documents GROUP BY 1, 2),
    p AS (SELECT repo, language, n, row_number() OVER (PARTITION BY repo ORDER BY n DESC, seen) AS r FROM c)
    SELECT repo, string_agg(language, ',' ORDER BY r) FILTER (WHERE r <= 4) AS primary_languages, round(sum(CASE WHEN language = 'python' THEN n ELSE 0 END) / sum(n), 3) AS python_share FROM p GROUP BY repo""")
def primary_languages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.when(F.col("lang") == "en", "python").otherwise(F.col("lang")).alias("language"), F.col("doc_id").alias("ord"), F.lit(False).alias("is_manifest"), F.lit(False).alias("is_document"))
    no_deps = docs.limit(0).select("repo", F.lit("").alias("name"), F.lit("").alias("file_path"), F.lit(0).alias("ord"))
    return digest.tech_stack(docs, no_deps, ["repo"]).select("repo", F.array_join("primary_languages", ",").alias("primary_languages"), "python_share")


@query(f"""WITH {_ISSUES}, h AS (SELECT source AS repo, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents),
    s AS (SELECT repo, 'Analysis measurements: ' || count(*) || ' files, ' || CAST(sum(n_chars) AS BIGINT) || ' lines' AS head, 'Top ranked hotspots:' || chr(10)
        || string_agg('- ' || doc_id || ' (score ' || n_chars || ', complexity ' || doc_id % 7 || ', 0 commits, 0 findings)', chr(10) ORDER BY r) FILTER (WHERE r <= 5) AS spots FROM h GROUP BY repo),
    l AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY doc_id) AS r FROM issues WHERE triage <> 'dismissed'),
    i AS (SELECT repo, 'Findings that survived triage:' || chr(10) || string_agg('- [' || severity || '] label at ' || doc_id || ':1 (' || triage || ')', chr(10) ORDER BY r) AS said FROM l WHERE r <= 8 GROUP BY repo)
    SELECT repo, concat_ws(chr(10), head, spots, said) AS digest FROM s LEFT JOIN i USING (repo)""")
def analysis_digest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("source", "repo")
    stats = docs.groupBy("repo").agg(F.count(F.lit(1)).alias("total_files"), F.sum("n_chars").alias("total_loc"))
    spots = docs.select("repo", F.struct(-F.col("n_chars"), "doc_id").alias("ord"), F.col("doc_id").alias("file_path"), F.col("n_chars").alias("score"), (F.col("doc_id") % 7).alias("complexity"), F.lit(None).cast("int").alias("commits"), F.lit(None).cast("int").alias("findings"))
    return digest.digest(stats, spots, issues(spark, sf_dir), ["repo"])
