"""Rules as a table: the compiled scan's findings, many rules, odd rules and files."""

import time

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import rulebook, scan
from corpusmill.plans.code import code_files
from tests.conftest import same


def test_as_the_compiled_scan(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select(F.col("doc_id").cast("string").alias("file_path"), F.concat_ws("\r\n", "text", F.lit('DEBUG = True\n# password = "0123456789abcdef"\npassword = "0123456789abcdef"')).alias("content"), F.lit(None).cast("string").alias("language"))
    for files in (code_files(spark, small), docs):
        want = scan.rule_findings(files)
        got = rulebook.findings(files, rulebook.table(spark))
        assert got.columns == want.columns and want.count() > 100
        same(got, want.toPandas())
        same(rulebook.findings(files, rulebook.table(spark), per_rule=2, block_chars=900), scan.rule_findings(files, per_rule=2).toPandas())


def test_thousands_of_rules(spark, small):
    files = code_files(spark, small)
    many = [scan.Rule(f"r{n}", "Name", "LOW", rf"\bname_{n}\s*=", anchors=((f"name_{n}",), ("=",))) for n in range(2_000)]
    text = files.withColumn("content", F.concat(F.col("content"), F.lit("\nname_7 = 1\nx name_1999= 2 name_3")))
    start = time.time()
    got = rulebook.findings(text, rulebook.table(spark, [*scan.RULES, *many]))
    found = {r.rule: r.n for r in got.groupBy("rule").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert time.time() - start < 60
    n = files.count()
    assert found["r7"] == found["r1999"] == n and not {"r3", "r70", "r199"} & set(found)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_odd_rules_and_files(spark):
    files = spark.createDataFrame([("a", "a.b and (X)\ncall(x)\n", "go"), ("a", "a.b and (X)\ncall(x)\n", "go"), ("b", "", None), ("c", None, "go"), ("d", "ÉTÉ call(x)\rcall(y)", ""), ("e", "z" * 200_000 + "\ncall(x)", None)], "file_path string, content string, language string")
    rules = spark.createDataFrame(
        [
            ("plain", "a, b", None, None, None), ("no-anchor", r"call\(", None, None, None), ("no-anchor", r"call\(", None, None, None), ("same-id", "X", [["x"]], None, None), ("same-id", r"\(x\)", [["(x)"]], None, None),
            ("python", "call", [["call"]], ["python"], None), ("empty", "", None, None, None), ("null", None, None, None, None), (None, "été", [["ÉTÉ", None]], None, None), ("blank", "z{3}", [[""], ["zz"]], None, "zzz"),
        ],
        "id string, pattern string, anchors array<array<string>>, languages array<string>, gate string",
    )
    rules = rules.withColumn("pattern", F.when(F.col("pattern") == "été", "(?iu)été").otherwise(F.col("pattern"))).withColumn("extra", F.lit(1))
    got = sorted((r.file_path, r.rule or "", r.line) for r in rulebook.findings(files, rules).collect())
    a = [("a", "no-anchor", 2), ("a", "same-id", 1), ("a", "same-id", 2)]
    assert got == sorted([*a, *a, ("d", "", 1), ("d", "no-anchor", 1), ("d", "no-anchor", 2), ("d", "python", 1), ("d", "python", 2), ("e", "blank", 1), ("e", "no-anchor", 2), ("e", "python", 2), *[(f, "same-id", n) for f, n in (("d", 1), ("e", 2))]])
    assert rulebook.findings(files, rules.limit(0)).count() == rulebook.findings(files.limit(0), rules).count() == 0
    with pytest.raises(ValueError, match="broken patterns: no-close"):
        rulebook.findings(files, spark.createDataFrame([("no-close", "(")], "id string, pattern string"))
