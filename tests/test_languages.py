"""The lexer and the islands: what each language hides in strings and comments, and what stands where no line begins."""

import time

import pytest

from corpusmill.operators import graph, lexing, parsing

CASES = {
    "typescript": (
        """import a from "./a";
import {
  b,
  c as d,
} from './b'; // import z from "./no"
/* import q from "./no2" */
export { e } from "./e"; export * from './f'; export * as g from "./g"
import type { T } from "./t";
const lazy = () => import("./lazy");
const r = require('r'), s = `import x from "./no3" ${ require("in-template") } }`;
const re = /["'`{]/g; const half = a / b / c;
class A { m() { if (x) { return `}`; } } get p(): {a: number} { return {a: 1} } static async *gen<T>(x: T): Promise<Array<T>> { for (;;) {} } abs(): void; }
export default function () { }
function named(a = {b: 1}): string { return a ? "x" : 'y' }
const f = (x) => { while (x) {} };
const o = { handler(a) { return 1 }, other: function inner() {} };
foo(a, function () { bar(b) })
if (x) { baz(y) }
interface I extends B { z(): void }
export abstract class K<T> extends L<T> { constructor(private x: number) { super() } }
""",
        ["./a", "./b", "./e", "./f", "./g", "./lazy", "./t", "in-template", "r"], ["gen:12:12:2", "m:12:12:2", "p:12:12:1", "named:14:14:2", "handler:16:16:1", "inner:16:16:1", "constructor:20:20:1"], ["A:12:12", "I:19:19", "K:20:20"],
    ),
    "java": (
        """package a.b; import java.util.*; import static x.Y.z; // import no.No;
/** import no.No2; */
@Ann({1,2}) public class A extends B { int x = foo(1); @Override public <T> List<T> get(Map<String, T> m) throws E { if (m == null) { return new Foo(x) { void on() {} }; } String s = "class Q {"; return null; }
  A(int x) { this(x); } abstract void abs(int y); interface N { int n(); } enum C { RED(1) { int v() { return 1; } }; } record P(int x) {} }
""",
        ["java.util", "x.Y.z"], ["get:3:3:2", "on:3:3:1", "A:4:4:1", "abs:4:4:1", "n:4:4:1", "v:4:4:1"], ["A:3:4", "N:4:4", "C:4:4", "P:4:4"],
    ),
    "go": (
        'package m\nimport (\n  "fmt"\n  // "no"\n  x "a/b"\n)\nimport "single"\ntype T struct { a int }\ntype I interface { M() }\nfunc (t *T) Run(a int) (interface{}, error) { if a > 1 { return nil, nil }; f := func() {}; return f, nil }\nfunc G[K comparable](k K) map[string]struct{} { return nil }\nvar s = `func no() {`\n',
        ["a/b", "fmt", "single"], ["Run:10:10:2", "G:11:11:1"], ["T:8:8", "I:9:9"],
    ),
    "rust": (
        "use std::{fs, io::{self, Read}}; use a::b as c; pub use crate::x::*;\n/* nested /* use no::no; */ still */\npub struct S<'a> { x: &'a str }\nimpl<'a> S<'a> { pub fn run(&self) -> i32 { if self.a { '}' as i32 } else { r#\"{\"#; 2 } } }\nimpl fmt::Display for S<'_> { fn fmt(&self) -> X where X: Y { } }\ntrait Q { fn sig(&self); }\nmod m { fn inner<T: A<B>>(x: T) {} }\n",
        ["a::b", "crate::x", "std::fs", "std::io", "std::io::Read"], ["run:4:4:2", "fmt:5:5:1", "sig:6:6:1", "inner:7:7:1"], ["S:3:3", "S<'a>:4:4", "S<'_>:5:5", "Q:6:6"],
    ),
    "cpp": (
        '#include <a.h>\n#include "b/c.h"\n// #include "no.h"\n#define X(a) { if (a) }\nstatic int f(int x) { while (x) { x--; } return x ? 1 : 2; }\nint g(void); struct P { int a; }; struct P *h(struct P *p) { return p; }\nnamespace n { class K : public B { public: K(int a) : a_(a) { } ~K() {} int m() const override { return 1; } }; }\nint n::K::q() { return R"(})"[0]; }\n',
        ["a.h", "b/c.h"], ["f:5:5:3", "h:6:6:1", "K:7:7:1", "K:7:7:1", "m:7:7:1", "q:8:8:1"], ["P:6:6", "K:7:7"],
    ),
    "csharp": (
        'using System; using A.B; using static C.D; using E = F.G; // using No;\nnamespace N { public class A : B { public A(int x) { } public int P { get; set; } public async Task<List<int>> Get(int x) { if (x > 1) { using (var y = Foo()) {} } return $"{x} {Bar("}")}"; } int E() => 1; string v = @"class "" {"; } interface I { void M(); } }\n',
        ["A.B", "C.D", "F.G", "System"], ["A:2:2:1", "E:2:2:1", "Get:2:2:2", "M:2:2:1"], ["A:2:2", "I:2:2"],
    ),
    "php": (
        "<?php\nnamespace A; use B\\C; use D\\{E, F as G}; // use No;\nrequire_once 'x.php'; include(\"y.php\");\n# function no() {}\nclass K extends L { use T; public function f($a) { if ($a) { return \"{$a[\"x\"]} }\"; } } }\nfunction g(): ?int { return 1; } $h = function () use ($x) { };\n$t = <<<EOT\nfunction no2() {\nEOT;\nfunction after() {}\n",
        ["B\\C", "D\\E", "D\\F", "x.php", "y.php"], ["f:5:5:2", "g:6:6:2", "after:10:10:1"], ["K:5:5"],
    ),
    "kotlin": (
        "package a\nimport b.c.D\nimport e.* // import no\nclass A(val x: Int) : B(x) { fun f(y: Int): Int { return if (y > 1) \"${y + \"}\"}\".length else 2 } fun g() = 1 }\ndata class P(val a: Int)\nobject O { fun String.ext(): Int = this.length }\nfun <T> List<T>.h(x: T) = when (x) {\n  is Int -> 1\n  else -> 2\n}\n/* /* fun no() {} */ */\n",
        ["b.c.D", "e"], ["f:4:4:2", "g:4:4:1", "ext:6:6:1", "h:7:10:3"], ["A:4:4", "P:5:5", "O:6:6"],
    ),
    "ruby": (
        "require 'json'\nrequire_relative \"lib/x\"\n# require 'no'\n=begin\ndef no; end\n=end\nmodule M\n  class A < B\n    def self.f(x)\n      return 1 if x\n      if x then y end\n      x.each do |z|\n        puts \"#{z} end\"\n      end\n    rescue E\n      2\n    end\n    def g = 1\n    def h?; true; end\n  end\nend\nt = <<~SQL\n  def no2\nSQL\ndef last\n  while x do y end\nend\n",
        ["./lib/x", "json"], ["f:9:17:2", "g:18:18:1", "h?:19:19:1", "last:25:27:1"], ["M:7:21", "A:8:20"],
    ),
}


@pytest.mark.parametrize("language", sorted(CASES))
def test_islands(language):
    text, imports, functions, classes = CASES[language]
    got = parsing.parse(text, language)
    assert got["imports"] == imports and got["parsed_with"] == "lexer"
    assert [f"{f['name']}:{f['start_line']}:{f['end_line']}:{f['complexity']}" for f in got["functions"]] == functions
    assert [f"{c['name']}:{c['start_line']}:{c['end_line']}" for c in got["classes"]] == classes


@pytest.mark.parametrize("language", sorted(CASES))
def test_any_cut_of_a_file_parses(language):
    """A file cut off anywhere gives facts, its blanked text keeps length and lines, and tokens stand in order."""
    text = CASES[language][0]
    for n in range(0, len(text), 7):
        parsing.parse(text[:n], language)
        read = lexing.lex(text[:n], language)
        assert len(read.bare) == n and read.bare.count("\n") == text[:n].count("\n")
        assert all(a <= b for a, b in zip(read.ends, read.starts[1:]))


def test_time_is_linear():
    for bad in ("function f() {\n", "{", '"', "`${", "/*", "class A { void f(", "import x ", "f(x) ", "import {a, ", "x => {", "<<A\n", "use a::{"):
        for language in CASES:
            began = time.time()
            parsing.parse(bad * 15_000, language)
            assert time.time() - began < 8, (bad, language)


def test_edges_of_imports_over_many_lines(spark):
    main = 'import {\n  a,\n  b,\n} from "./lib/a.js";\nexport { c } from "./c";\n// import d from "./d";\nconst e = await import("./e");\nconst s = `import f from "./f"`;\n'
    rows = [("main.ts", "typescript", main), *[(f"{x}.ts", "typescript", "") for x in ("lib/a", "c", "d", "e", "f")], ("k.rb", "ruby", "require_relative 'k2'\n"), ("k2.rb", "ruby", "")]
    edges, _ = graph.resolve(parsing.facts(spark.createDataFrame(rows, "file_path string, language string, content string")))
    assert {(r.source, r.target) for r in edges.collect()} == {("main.ts", "lib/a.ts"), ("main.ts", "c.ts"), ("main.ts", "e.ts")} | {(r.source, r.target) for r in edges.filter("source = 'k.rb'").collect()}
