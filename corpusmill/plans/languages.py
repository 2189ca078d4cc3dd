"""Queries over files of many languages: each document's own words stand in a comment of a file that is made around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import held
from ..operators import graph, parsing
from .registry import pick, query, table, text_sql

# language, file ending, text (@: the document's number, %: its words), imports, functions (name, complexity, line below the words), classes
SAMPLES: list[tuple[str, str, str, list[str], list[tuple[str, int, int]], list[str]]] = [
    (
        "typescript", "ts",
        "/* % import gone from './gone' */\nimport {\n  a,\n  b as c,\n} from './m@';\nexport { d } from \"./deep/d@\"; // import x from './no'\nimport type { T } from 'pkg-@';\nconst lazy = () => import('./lazy@'), s = `import y from './no' ${ f(`}`) } {`;\n"
        "export class K@ extends L { m@(x: number): { a: number } { if (x) { return { a: 1 }; } return { a: x ? 2 : 3 }; } get g() { return /[{'\"]/; } }\nfunction f@(z) { for (;;) { while (z) {} } }\n",
        ["./deep/d@", "./lazy@", "./m@", "pkg-@"], [("g", 1, 9), ("m@", 3, 9), ("f@", 3, 10)], ["K@"],
    ),
    (
        "go", "go", "/* % */\npackage p@\nimport (\n  \"fmt\"\n  // \"no\"\n  x \"mod/q@\"\n)\ntype T@ struct { a int }\nfunc (t *T@) Run@(a int) (interface{}, error) { if a > 1 { return nil, nil }; return `func no() {`, nil }\nfunc G@[K any](k K) {\n  for {\n  }\n}\n",
        ["fmt", "mod/q@"], [("Run@", 2, 9), ("G@", 2, 10)], ["T@"],
    ),
    (
        "rust", "rs", "/* % /* nested */ use no::no; */\nuse std::{fs, io::{self, Read}};\npub use crate::m@::*;\nstruct S@<'a> { x: &'a str }\nimpl<'a> S@<'a> { fn run@(&self) -> char { if self.x { r#\"{\"# } else { '}' } } }\ntrait Q@ { fn sig(&self); }\n",
        ["crate::m@", "std::fs", "std::io", "std::io::Read"], [("run@", 2, 5), ("sig", 1, 6)], ["S@", "S@<'a>", "Q@"],
    ),
    (
        "java", "java", "/* % import no.No; */\npackage a;\nimport a.b.C@; // import no.No;\nimport static x.Y@.z; import java.util.*;\n@Ann({1, 2}) class A@ extends B { List<String> get@(int x) throws E { if (x > 0) { return foo(1); } String s = \"class Q {\"; return null; } A@(int x) { } abstract void v@(); }\n",
        ["a.b.C@", "java.util", "x.Y@.z"], [("A@", 1, 5), ("get@", 2, 5), ("v@", 1, 5)], ["A@"],
    ),
    (
        "c", "c", "/* %\n#include <no.h> */\n#include <a.h>\n#include \"b/c@.h\"\n#define X(a) { if (a) }\nstatic int f@(int x) { while (x) { x--; } return x ? 1 : '}'; }\nint g@(void);\nstruct P@ { int a; };\n",
        ["a.h", "b/c@.h"], [("f@", 3, 6)], ["P@"],
    ),
    (
        "php", "php", "<?php /* % */\nuse B\\C@; use D\\{E@, F as G}; # use No;\nrequire_once 'x@.php';\nclass K@ { use T; public function f@($a) { if ($a) { return \"{$a[\"x\"]} }\"; } } }\n$t = <<<EOT\nfunction no() {\nEOT;\nfunction g@(): int { return 1; }\n",
        ["B\\C@", "D\\E@", "D\\F", "x@.php"], [("f@", 2, 4), ("g@", 1, 8)], ["K@"],
    ),
    (
        "kotlin", "kt", "/* % /* import no.no */ */\npackage a\nimport b.c.D@\nimport e@.* // import no\nclass A@(val x: Int) : B(x) { fun f@(y: Int): Int { return if (y > 1) \"${y + \"}\"}\".length else 2 } }\nobject O@ { fun String.ext@(): Int = this.length }\n",
        ["b.c.D@", "e@"], [("f@", 2, 5), ("ext@", 1, 6)], ["A@", "O@"],
    ),
    (
        "ruby", "rb", "# words\n=begin\n%\ndef no; end\n=end\nrequire 'json@'\nrequire_relative \"lib/x@\"\nmodule M@\n  class A@ < B\n    def self.f@(x)\n      return 1 if x\n      x.each do |z|\n        puts \"#{z} end\"\n      end\n    rescue E\n      2\n    end\n    def g@ = 1\n  end\nend\n",
        ["./lib/x@", "json@"], [("f@", 2, 10), ("g@", 1, 18)], ["M@", "A@"],
    ),
]

_WORDS = "regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,\\n]', ' ', 'g')"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, repo_id, file_path, language, content: a file of one of eight languages for each document, its whole text within."""
    d, doc = F.col("doc_id"), F.col("doc_id").cast("string")
    words = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^A-Za-z0-9 .,\n]", " ")
    content = F.replace(F.replace(pick([s[2] for s in SAMPLES], d), F.lit("@"), doc), F.lit("%"), words)
    path = F.concat(F.lit("src/f"), doc, F.lit("."), pick([s[1] for s in SAMPLES], d))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("r"), (d % 5).cast("string")).alias("repo_id"), path.alias("file_path"), pick([s[0] for s in SAMPLES], d).alias("language"), content.alias("content"))


def _case(value) -> str:
    return "CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN {value(s)}" for k, s in enumerate(SAMPLES)) + " END"


def _named(x: str) -> str:
    return f"replace({text_sql(x)}, '@', CAST(doc_id AS VARCHAR))"


def _joined(xs: list[str]) -> str:
    return " || ',' || ".join(xs) if xs else "''"


def _function(f: tuple[str, int, int]) -> str:
    return f"{_named(f[0])} || ':{f[1]}:' || ({f[2]} + nl)"


@query(f"""WITH d AS (SELECT doc_id, length({_WORDS}) - length(replace({_WORDS}, chr(10), '')) AS nl FROM documents)
    SELECT doc_id, {_case(lambda s: text_sql(s[0]))} AS language, 'lexer' AS parsed_with, list_aggregate(list_sort(string_split({_case(lambda s: _joined([_named(x) for x in s[3]]))}, ',')), 'string_agg', ',') AS imports,
        {_case(lambda s: _joined([_function(f) for f in s[4]]))} AS functions, {_case(lambda s: _joined([_named(x) for x in s[5]]))} AS classes, CAST({_case(lambda s: str(s[2].count(chr(10))))} + nl AS INTEGER) AS loc FROM d""")
def parsed_languages(spark, sf_dir):
    """Imports over many lines, handed on, loaded late or commented out; classes of one line; functions wherever they stand."""
    out = parsing.facts(sources(spark, sf_dir))
    name = lambda f: F.concat_ws(":", f["name"], f["complexity"].cast("string"), f["start_line"].cast("string"))
    return out.select(
        F.regexp_extract("file_path", r"src/f(\d+)\.", 1).cast("bigint").alias("doc_id"), "language", "parsed_with", F.array_join(F.array_sort("imports"), ",").alias("imports"),
        F.array_join(F.transform("functions", name), ",").alias("functions"), F.array_join(F.transform("classes", lambda c: c["name"]), ",").alias("classes"), "loc",
    )


@query("""WITH d AS (SELECT doc_id, 'r' || doc_id % 5 AS repo_id, doc_id % 8 AS k FROM documents)
    SELECT repo_id, 'src/f' || doc_id || '.ts' AS source, 'src/' || unnest(['m' || doc_id || '.ts', 'deep/d' || doc_id || '/index.ts', 'lazy' || doc_id || '.js']) AS target FROM d WHERE k = 0""")
def language_edges(spark, sf_dir):
    """Edges of what the files above import, to files that lie where the specifiers say."""
    rows = sources(spark, sf_dir)
    # parsed once, though the resolution reads it as what is known and as what is asked for
    parsed = held.cut(parsing.facts(rows).select("file_path", "imports")).join(rows.select("repo_id", "file_path"), "file_path")
    doc = F.regexp_extract("file_path", r"src/f(\d+)\.", 1)
    beside = {".ts": [("src/m", ".ts"), ("src/deep/d", "/index.ts"), ("src/lazy", ".js")]}
    more = [rows.filter(F.endswith("file_path", F.lit(end))).select("repo_id", F.concat(F.lit(a), doc, F.lit(b)).alias("file_path")) for end, names in beside.items() for a, b in names]
    every = parsed.select("repo_id", "file_path", "imports")
    for files in more:
        every = every.unionByName(files.withColumn("imports", F.array().cast("array<string>")))
    return graph.resolve(every)[0]
