"""Rules that are a table, over whole documents and files of code, and look-ups called from SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lookups, rulebook, scan
from .code import _CODE_FOUND, code_files
from .registry import SNIPPET, query, table

_LETTERS = r"A-Za-zÀ-ÿ"
_SQL_LETTERS = r"A-Za-z\x{C0}-\x{FF}"


def word_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule for each word of ten and more letters in a benchmark item; those of eleven letters look at English texts alone."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{10,}"), F.lit(0))).alias("w")).distinct()
    pattern = F.concat(F.lit(f"(?i)(?<![{_LETTERS}])"), "w", F.lit(f"(?![{_LETTERS}])"))
    some = F.when(F.length("w") == 11, F.array(F.lit("en"))).otherwise(F.array().cast("array<string>"))
    return words.select(F.concat(F.lit("word-"), "w").alias("id"), F.when(F.length("w") > 12, "HIGH").otherwise("LOW").alias("severity"), pattern.alias("pattern"), F.array(F.array("w")).alias("anchors"), some.alias("languages"))


@query(rf"""WITH rules AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{10,}}')) AS w FROM benchmark),
    lines AS (SELECT doc_id, coalesce(lang, '') AS lang, unnest(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS t, generate_subscripts(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), 1) AS line FROM documents WHERE text <> ''),
    met AS (SELECT DISTINCT doc_id, lang, line, lower(w) AS w FROM (SELECT doc_id, lang, line, unnest(regexp_extract_all(t, '[{_SQL_LETTERS}]+')) AS w FROM lines)),
    placed AS (SELECT doc_id, w, line, row_number() OVER (PARTITION BY doc_id, w ORDER BY line) AS n FROM met JOIN rules USING (w) WHERE length(w) <> 11 OR lang IN ('', 'en'))
    SELECT doc_id, 'word-' || w AS rule, CASE WHEN length(w) > 12 THEN 'HIGH' ELSE 'LOW' END AS severity, line FROM placed WHERE n <= 5""")
def rule_table_findings(spark, sf_dir):
    """Hundreds of rules from a table over every document: whole words, by language, five lines a rule and document."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"), F.col("lang").alias("language"))
    return rulebook.findings(docs, word_rules(spark, sf_dir)).select(F.col("file_path").cast("bigint").alias("doc_id"), "rule", "severity", "line")


@query(f"{_CODE_FOUND} SELECT rule || ':' || file_path || ':' || line AS id, rule, severity, CAST(line AS BIGINT) AS line, {SNIPPET} AS snippet, 'pattern' AS detector FROM found WHERE entropy IS NULL")
def rule_table_code(spark, sf_dir):
    """The scan's own eighteen rules as a table, over files of code: what the compiled scan finds."""
    found = rulebook.findings(code_files(spark, sf_dir), rulebook.table(spark, scan.RULES))
    return found.select("id", "rule", "severity", "line", "snippet", "detector")


_PATH = "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 7 = 1 THEN '../' || doc_id WHEN doc_id % 7 = 2 THEN NULL ELSE CAST(doc_id // 50 * 50 + doc_id * 3 % 50 AS VARCHAR) END"


@query(f"""WITH f AS (SELECT 'r' || doc_id // 50 AS repo_id, CAST(doc_id AS VARCHAR) AS p, text FROM documents), a AS (SELECT doc_id, 'r' || doc_id // 50 AS repo_id, {_PATH} AS path FROM documents),
    e AS (SELECT repo_id, p AS source, 'p' || length(text) % 9 AS target FROM f WHERE text IS NOT NULL), d AS (SELECT repo_id, source, target FROM e)
    SELECT doc_id, path, length(CASE WHEN text <> '' THEN substr(text, 1, 8000) END) AS n_read, CAST(CASE WHEN text <> '' THEN length(text) - length(replace(text, chr(10), '')) + 1 END AS INTEGER) AS lines, CASE WHEN text <> '' THEN length(text) > 8000 END AS truncated,
        CASE WHEN coalesce(path, '') = '' THEN 'path is required' WHEN coalesce(text, '') = '' THEN 'could not read ' || path END AS error, CASE WHEN f.p IS NOT NULL THEN coalesce(d.target, '') END AS dependency
    FROM a LEFT JOIN f ON f.repo_id = a.repo_id AND f.p = a.path LEFT JOIN d ON d.repo_id = a.repo_id AND d.source = a.path""")
def lateral_lookups(spark, sf_dir):
    """Every document asks for another file of its repository, and for what that imports: LATERAL calls of SQL."""
    d = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").withColumn("repo_id", F.concat(F.lit("r"), F.floor(d / 50).cast("string")))
    files = docs.select("repo_id", d.cast("string").alias("file_path"), F.col("text").alias("content"), d.alias("ord"))
    edges = files.filter("content is not null").select("repo_id", F.col("file_path").alias("source"), F.concat(F.lit("p"), (F.length("content") % 9).cast("string")).alias("target"))
    lookups.register(files, edges)
    path = F.when(d % 7 == 0, "").when(d % 7 == 1, F.concat(F.lit("../"), d.cast("string"))).when(d % 7 == 2, None).otherwise(((F.floor(d / 50) * 50 + d * 3 % 50).cast("string")))
    docs.select("doc_id", "repo_id", path.alias("path")).createOrReplaceTempView("lookup_asks")
    return spark.sql("""SELECT a.doc_id, r.path, length(r.content) AS n_read, r.lines, r.truncated, r.error, CASE WHEN l.error IS NULL THEN coalesce(try_element_at(l.dependencies, 1), '') END AS dependency
        FROM lookup_asks a, LATERAL read_file(a.repo_id, a.path) r, LATERAL list_dependencies_of_file(a.repo_id, a.path) l""")
