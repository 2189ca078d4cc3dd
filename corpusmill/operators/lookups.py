"""The three look-ups as table functions of SQL: by LATERAL for each row of a query, for all repositories at once. None of them raises.

``read_file`` and ``list_dependencies_of_file`` are SQL functions, so a LATERAL call of them becomes joins on repository and
path. ``search_code`` is a Python table function of a partitioned table, which ``asked_lines`` makes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from .tools import HITS, READ, SEARCHED_FILES

FOUND = "ask string, file_path string, line int, text string, error string"


class SearchCode:
    """Rows of ``FOUND`` for a table(ask, query, most, file_path, content) by ask, in order of file_path: the first lines that match.

    A broken pattern is literal text; an empty or null one gives a row with an error; most lies between 1 and 25, null is 25.
    """

    def __init__(self) -> None:
        self.pattern: re.Pattern | None = None
        self.left, self.told, self.ask = -1, False, None

    def eval(self, row: Row) -> Iterator[tuple]:
        if self.left < 0:
            self.ask, query = row["ask"], (row["query"] or "").strip()
            self.left = max(1, min(HITS, row["most"] or HITS))
            try:
                self.pattern = re.compile(query, re.I) if query else None
            except (re.error, RecursionError, OverflowError):
                self.pattern = re.compile(re.escape(query), re.I)
        if self.pattern is None:
            if not self.told:
                self.told = True
                yield self.ask, None, None, None, "query is required"
            return
        if self.left == 0 or row["file_path"] is None:
            return
        lines = (row["content"] or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for k, line in enumerate(lines):
            if self.left and self.pattern.search(line):
                self.left -= 1
                yield self.ask, row["file_path"], k + 1, line.strip()[:200], None


def register(files: DataFrame, edges: DataFrame) -> None:
    """Makes the functions and the views they read, of files(repo_id, file_path, content, ord?) and edges(repo_id, source, target), for the session.

    - ``read_file(repo, path)``: path, content (8,000 characters), lines, truncated, error; always one row.
    - ``list_dependencies_of_file(repo, path)``: path, dependencies, dependents, error; one row. ``known_files(repo)``: known, the first twenty files; one row.
    - ``search_code(TABLE(...) PARTITION BY ask ORDER BY file_path)``: matching lines, over ``asked_lines``.

    Paths are compared as they are: a call becomes equi-joins only where an argument stands alone, so callers trim. A path
    that is null or blank, that climbs or is not among the files has an error; a repository that is null or
    unknown has no files. Of repeated files the greatest content counts; repeated edges count once.
    """
    spark = files.sparkSession
    some = files.filter("repo_id is not null and file_path is not null")
    some.groupBy("repo_id", "file_path").agg(F.max("content").alias("content")).createOrReplaceTempView("lookup_files")
    place = Window.partitionBy("repo_id").orderBy(*(["ord"] if "ord" in files.columns else []), "file_path")
    some.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= SEARCHED_FILES).select("repo_id", "file_path", F.substring("content", 1, READ).alias("content")).createOrReplaceTempView("lookup_heads")
    ends = edges.filter("source is not null and target is not null")
    down = ends.select("repo_id", F.col("source").alias("path"), F.col("target").alias("dependency"), F.lit(None).cast("string").alias("dependent"))
    up = ends.select("repo_id", F.col("target").alias("path"), F.lit(None).cast("string").alias("dependency"), F.col("source").alias("dependent"))
    here = some.select("repo_id", F.col("file_path").alias("path"), F.lit(None).cast("string").alias("dependency"), F.lit(None).cast("string").alias("dependent"))
    links = down.unionByName(up).unionByName(here).groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("dependency")).alias("dependencies"), F.array_sort(F.collect_set("dependent")).alias("dependents"))
    links.createOrReplaceTempView("lookup_links")
    first = some.select("repo_id", "file_path").distinct().withColumn("n", F.row_number().over(Window.partitionBy("repo_id").orderBy("file_path"))).filter("n <= 20")
    first.groupBy("repo_id").agg(F.array_sort(F.collect_list("file_path")).alias("known")).createOrReplaceTempView("lookup_known")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION read_file(repo STRING, path STRING) RETURNS TABLE(path STRING, content STRING, lines INT, truncated BOOLEAN, error STRING)
        RETURN SELECT read_file.path, CASE WHEN content <> '' THEN substring(content, 1, {READ}) END, CASE WHEN content <> '' THEN length(content) - length(replace(content, '\\n')) + 1 END, CASE WHEN content <> '' THEN length(content) > {READ} END,
            CASE WHEN coalesce(btrim(read_file.path), '') = '' THEN 'path is required' WHEN coalesce(content, '') = '' THEN concat('could not read ', read_file.path) END
        FROM (SELECT max(f.content) AS content FROM lookup_files f WHERE f.repo_id = read_file.repo AND f.file_path = read_file.path)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION list_dependencies_of_file(repo STRING, path STRING) RETURNS TABLE(path STRING, dependencies ARRAY<STRING>, dependents ARRAY<STRING>, error STRING)
        RETURN SELECT list_dependencies_of_file.path, dependencies, dependents, CASE WHEN dependencies IS NULL THEN concat(coalesce(list_dependencies_of_file.path, ''), ' is not known') END
        FROM (SELECT max(l.dependencies) AS dependencies, max(l.dependents) AS dependents FROM lookup_links l WHERE l.repo_id = list_dependencies_of_file.repo AND l.path = list_dependencies_of_file.path)""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION known_files(repo STRING) RETURNS TABLE(known ARRAY<STRING>)
        RETURN SELECT coalesce(known, array()) FROM (SELECT max(k.known) AS known FROM lookup_known k WHERE k.repo_id = known_files.repo)""")
    spark.udtf.register("search_code", F.udtf(SearchCode, returnType=FOUND))


def asked_lines(asks: DataFrame, name: str = "asked_lines") -> None:
    """The view that ``search_code`` takes, of asks(ask, repo_id, query, most?): each with the heads of its repository's first 400 files, or one row without a file."""
    heads = asks.sparkSession.table("lookup_heads")
    most = F.col("most").try_cast("int") if "most" in asks.columns else F.lit(None).cast("int")
    some = asks.select(F.col("ask").cast("string").alias("ask"), "repo_id", "query", most.alias("most"))
    some.join(heads, "repo_id", "left").select("ask", "query", "most", "file_path", "content").createOrReplaceTempView(name)
