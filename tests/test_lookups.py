"""Look-ups as table functions: the answers of the driver's look-ups, for many repositories at once, and odd calls."""

from pyspark.sql import functions as F

from corpusmill.operators import lookups, tools

FILES = [
    ("r", "a.py", "x = 1\ny = (2", 1), ("r", "b.py", "y(\r\nz" + "q" * 9_000, 2), ("r", "e.py", "", 3), ("r", "n.py", None, 4), ("q", "a.py", "only y(", 1), ("q", "a.py", "", 1), (None, "a.py", "lost", 1),
    *[("m", f"f{k:03}.py", "\n".join(["y"] * 2), k) for k in range(420)],
]
EDGES = [("r", "a.py", "b.py"), ("r", "a.py", "b.py"), ("r", "a.py", "c.py"), ("q", "z.py", "a.py"), ("r", None, "b.py")]


def made(spark):
    files = spark.createDataFrame(FILES, "repo_id string, file_path string, content string, ord int")
    edges = spark.createDataFrame(EDGES, "repo_id string, source string, target string")
    lookups.register(files, edges)
    return files, edges


def test_reading_and_links(spark):
    files, edges = made(spark)
    asks = [(k, repo, path) for k, (repo, path) in enumerate((r, p) for r in ("r", "q", "no", None) for p in ("a.py", "b.py", "e.py", "n.py", "", None, "../a.py", "/etc/passwd", "c.py", "z.py"))]
    spark.createDataFrame(asks, "k int, repo string, path string").createOrReplaceTempView("some_asks")
    read = {r.k: r for r in spark.sql("SELECT k, r.* FROM some_asks, LATERAL read_file(repo, path) r").collect()}
    links = {r.k: r for r in spark.sql("SELECT k, l.* FROM some_asks, LATERAL list_dependencies_of_file(repo, path) l").collect()}
    assert len(read) == len(links) == len(asks)
    for repo in ("r", "q"):
        one = files.filter(F.col("repo_id") == repo)
        one = one.groupBy("file_path").agg(F.max("content").alias("content"), F.min("ord").alias("ord"))
        driver = tools.Tools(one, edges.filter(F.col("repo_id") == repo).filter("source is not null").distinct())
        for k, of, path in asks:
            if of != repo or path is None:
                continue
            want = driver.execute("read_file", {"path": path})
            assert read[k].error == want.get("error") and (read[k].error or (read[k].content, read[k].lines, read[k].truncated) == (want["content"], want["lines"], want["truncated"])), (of, path)
            if path:
                want = driver.execute("list_dependencies_of_file", {"path": path})
                assert links[k].error == want.get("error"), (of, path)
                assert links[k].error or (links[k].dependencies, links[k].dependents) == (want["dependencies"], want["dependents"]), (of, path)
    for k, of, path in asks:
        if of in ("no", None):
            assert read[k].content is None and read[k].error and links[k].error.endswith("is not known")
    known = {r.repo: r.known for r in spark.sql("SELECT DISTINCT s.repo, f.known FROM some_asks s, LATERAL known_files(s.repo) f").collect()}
    assert known == {"r": ["a.py", "b.py", "e.py", "n.py"], "q": ["a.py"], "no": [], None: []}
    for call in ("read_file", "list_dependencies_of_file"):
        plan = spark.sql(f"SELECT k, l.* FROM some_asks, LATERAL {call}(repo, path) l")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert spark.sql("SELECT content FROM read_file('q', 'a.py')").first().content == "only y("


def test_searching(spark):
    files, edges = made(spark)
    asks = [("1", "r", "y", None), ("2", "q", "y", 1), ("3", "r", "(", 9), ("4", "r", "  ", 3), ("5", "r", None, 3), ("6", "no", "y", 3), ("7", "m", "Y", 99), ("8", "m", "y", -4), ("9", "r", "nothing here", 2), ("10", "r", "q{100}$", 5)]
    lookups.asked_lines(spark.createDataFrame(asks, "ask string, repo_id string, query string, most int"))
    found = spark.sql("SELECT * FROM search_code(TABLE(asked_lines) PARTITION BY ask ORDER BY file_path)").collect()
    by = {a: sorted((r.file_path, r.line, r.text) for r in found if r.ask == a and r.error is None) for a, *_ in asks}
    assert {r.ask: r.error for r in found if r.error} == {"4": "query is required", "5": "query is required"}
    for repo in ("r", "q", "m"):
        one = files.filter(F.col("repo_id") == repo).groupBy("file_path").agg(F.max("content").alias("content"), F.min("ord").alias("ord"))
        driver = tools.Tools(one, edges)
        for ask, of, query, most in asks:
            if of == repo and (query or "").strip():
                want = driver.execute("search_code", {"query": query, "max_results": most})["matches"]
                assert by[ask] == sorted((m["file_path"], m["line"], m["text"]) for m in want) if query != "(" else by[ask] == [("a.py", 2, "y = (2"), ("b.py", 1, "y(")], ask
    assert by["6"] == by["9"] == [] and len(by["10"]) == 1 and len(by["7"]) == 25 and len(by["8"]) == 1 and by["2"] == [("a.py", 1, "only y(")]
