"""Files to facts: complexity, functions, classes and imports; a syntax tree for Python, islands of tokens or patterns for the rest."""

from __future__ import annotations

import ast
import bisect
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import islands, lexing

OUT = "file_path string, language string, complexity int, loc int, comment_lines int, functions array<struct<name:string,start_line:int,end_line:int,complexity:int,lines:int>>, classes array<struct<name:string,start_line:int,end_line:int>>, imports array<string>, parsed_with string"
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.match_case)
_STRINGS = re.compile(r"""//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", re.S)
_HASHED = re.compile(r"""#[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'""", re.S)
_TERNARY = r"(?<![?.])\?(?![?.:])"
#: What counts as a branch, by language: a loop's tail in do-while stands for its head, and case labels count in scripts alone.
_BRANCHING = {
    "javascript": rf"\b(?:if|for|while|case|catch)\b|{_TERNARY}", "go": r"\b(?:if|for)\b", "java": rf"\b(?:if|while|catch)\b|\bfor\s*\([^;)]*;|{_TERNARY}", "c": rf"\b(?:if|for|while)\b|{_TERNARY}", "cpp": rf"\b(?:if|while|catch)\b|\bfor\s*\([^;)]*;|{_TERNARY}",
    "csharp": rf"\b(?:if|for|foreach|while|catch)\b|{_TERNARY}", "rust": r"\bif\b", "php": rf"\b(?:if|for|foreach|while|catch)\b|{_TERNARY}", "ruby": r"\brescue\b", "kotlin": r"\b(?:if|for|while)\b|->", "lua": r"\b(?:if|for|while)\b",
}
_ANY_BRANCH = rf"\b(?:if|for|while|case|catch|elif|foreach|when|unless|until|rescue)\b|{_TERNARY}"
_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|function|return|else|do|new|throw|synchronized|try|using|lock|foreach|elseif)\b)"
_FUNCTIONS = re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:pub(?:\([^)]*\))?\s+)?(?:public\s+|private\s+|protected\s+|static\s+|async\s+|final\s+|override\s+|suspend\s+|local\s+|unsafe\s+|const\s+)*(?:function\*?|func(?:\s*\([^)]*\))?|fn|def|fun)\s+(?:self\.)?([A-Za-z_$][\w$]*)")
#: Methods of a class body in scripts; methods and functions with a type before their name.
_METHODS = re.compile(rf"(?m)^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+|\*\s*)*{_NOT_NAMES}([A-Za-z_$#][\w$]*)\s*(?:<[^>{{}}]*>)?\([^;{{}}]*\)\s*(?::\s*[^{{;=\n]+)?\{{")
_TYPED = re.compile(rf"(?m)^[ \t]*(?:@\w+\s+)*(?:{_NOT_NAMES}[\w<>\[\],.*&:]+\s+[*&]*)+{_NOT_NAMES}([A-Za-z_~]\w*)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:throws\s+[\w., ]+)?\{{")
_CONSTRUCTORS = re.compile(rf"(?m)^[ \t]*(?:public|private|protected)\s+{_NOT_NAMES}([A-Z]\w*)\s*\([^;{{}}]*\)\s*(?:throws\s+[\w., ]+)?\{{")
_SHAPES = {"javascript": [_FUNCTIONS, _METHODS], "java": [_TYPED, _CONSTRUCTORS], "csharp": [_TYPED, _CONSTRUCTORS], "c": [_TYPED], "cpp": [_TYPED]}
_CLASSES = re.compile(r"(?m)^[ \t]*(?:export\s+)?(?:default\s+)?(?:pub(?:\([^)]*\))?\s+)?(?:public\s+|private\s+|protected\s+|static\s+|abstract\s+|final\s+|sealed\s+|data\s+|open\s+)*(?:class|interface|struct|trait|enum|impl(?:<[^>]*>)?(?:\s+[\w:<>]+\s+for)?|type(?=\s+\w+\s+(?:struct|interface)\b))\s+([A-Za-z_]\w*)")
# Imports by pattern, language by language, in this order; the first group that matched is the name.
IMPORTS = {
    "python": [r"(?m)^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"],
    "javascript": [r"""import\s+.*?from\s+['"]([^'"]+)['"]""", r"""import\s+['"]([^'"]+)['"]""", r"""require\(\s*['"]([^'"]+)['"]\s*\)"""],
    "go": [r"""(?m)^\s*import\s+"([^"]+)\""""],
    "java": [r"(?m)^import\s+(?:static\s+)?([\w.]+)"],
    "rust": [r"(?m)^\s*(?:pub\s+)?use\s+([\w:]+)"],
    "c": [r"""(?m)^\s*#\s*include\s*[<"]([^>"]+)[>"]"""],
}
#: The import block of Go, of which every quoted name is one.
GO_BLOCK = r"(?s)import\s*\((.*?)\)"
_ALIASES = {"typescript": "javascript", "kotlin": "java", "scala": "java", "cpp": "c"}


def _named(pattern: str):
    """Of a match of ``pattern`` the group that took part."""
    one = lambda m: F.regexp_extract(m, pattern, 1)
    return one if re.compile(pattern).groups == 1 else lambda m: F.when(one(m) != "", one(m)).otherwise(F.regexp_extract(m, pattern, 2))


def imports(text: Column, language: str) -> Column:
    """The imports of a text by the language's patterns, each once, as first found: an ARRAY<STRING> without Python."""
    text, found = X.clean_lines(text), []
    kind = _ALIASES.get(language, language)
    for p in IMPORTS.get(kind, []):
        found.append(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), _named(p)))
    if kind == "go":
        found.append(F.regexp_extract_all(F.regexp_extract(text, GO_BLOCK, 1), F.lit('"([^"]+)"'), F.lit(1)))
    return F.array_distinct(F.filter(F.concat(*found), lambda x: x != "")) if found else F.array().cast("array<string>")


def imports_of(text: str, language: str) -> list[str]:
    """``imports`` of a text at hand."""
    kind = _ALIASES.get(language, language)
    found = [next(g for g in m.groups() if g) for p in IMPORTS.get(kind, []) for m in re.finditer(p, text) if any(m.groups())]
    block = re.search(GO_BLOCK, text) if kind == "go" else None
    return list(dict.fromkeys(found + (re.findall(r'"([^"]+)"', block[1]) if block else [])))


def branches(node: ast.AST) -> int:
    """Branches below a node; handlers of exception groups are none, a boolean chain has one for each operator."""
    count = sum(isinstance(n, _BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in ast.walk(node))
    return count + sum(len(n.handlers) for n in ast.walk(node) if isinstance(n, ast.Try))


def _comments(text: str) -> int:
    """Comments, not lines of them."""
    try:
        return sum(t.type == tokenize.COMMENT for t in tokenize.generate_tokens(io.StringIO(text).readline))
    except (tokenize.TokenError, IndentationError, SyntaxError):
        return 0


def parse_python(text: str) -> dict:
    """Imports are modules and the names taken from them, each once, in order; what is taken from the future is none."""
    tree = ast.parse(text)
    functions = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    named = {a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names}
    for n in ast.walk(tree):
        if isinstance(n, ast.ImportFrom) and (n.level or n.module != "__future__"):
            named |= {"." * n.level + (n.module or "")} | {a.name for a in n.names if a.name != "*"}
    return {
        "complexity": 1 + branches(tree), "parsed_with": "syntax-tree", "imports": sorted(named), "comment_lines": _comments(text),
        "functions": [{"name": n.name, "start_line": n.lineno, "end_line": n.end_lineno, "complexity": 1 + branches(n), "lines": n.end_lineno - n.lineno + 1} for n in sorted(functions, key=lambda n: n.lineno)],
        "classes": [{"name": n.name, "start_line": n.lineno, "end_line": n.end_lineno} for n in ast.walk(tree) if isinstance(n, ast.ClassDef)],
    }


def parse_patterns(text: str, language: str, parsed_with: str = "patterns") -> dict:
    """Braces end a function; strings and comments are blanked first, line ends kept. Nested functions count in both."""
    quoted = _HASHED if language in ("ruby", "bash", "elixir", "perl", "r") else _STRINGS
    comments = sum(m[0][0] in "/#" for m in quoted.finditer(text))
    bare = quoted.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    kind = _ALIASES.get(language, language)
    branch = re.compile(_BRANCHING.get(language, _BRANCHING.get(kind, _ANY_BRANCH)))
    ends = [m.start() for m in re.finditer("\n", bare)]
    # where each brace is closed, found once; what is never closed ends with the text
    closed, opened = {}, []
    for m in re.finditer(r"[{}]", bare):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            closed[opened.pop()] = m.start()
    braces = sorted(closed)

    def span(at: int) -> tuple[int, int, int]:
        first = bisect.bisect_left(ends, at) + 1
        k = bisect.bisect_left(braces, at)
        end = closed[braces[k]] if k < len(braces) else at
        return first, bisect.bisect_left(ends, end) + 1, end

    functions, seen = [], set()
    for shape in _SHAPES.get(language, _SHAPES.get(kind if kind == "javascript" else "", [_FUNCTIONS])):
        for m in shape.finditer(bare):
            if m.start(1) in seen:
                continue
            seen.add(m.start(1))
            a, b, end = span(m.start(1))
            begin = bare.rfind("\n", 0, m.start(1)) + 1
            functions.append({"name": m[1], "start_line": a, "end_line": b, "complexity": 1 + sum(1 for _ in branch.finditer(bare, begin, end + 1)), "lines": b - a + 1})
    return {
        "complexity": 1 + len(branch.findall(bare)), "parsed_with": parsed_with, "functions": sorted(functions, key=lambda f: (f["start_line"], f["name"])), "imports": imports_of(text, language) if parsed_with == "regex" else sorted(imports_of(text, language)), "comment_lines": comments,
        "classes": [{"name": m[1], "start_line": (s := span(m.start(1)))[0], "end_line": s[1]} for m in _CLASSES.finditer(bare)],
    }


def parse(text: str, language: str) -> dict:
    if language == "python":
        try:
            return parse_python(text)
        except (SyntaxError, ValueError, RecursionError):
            return {"complexity": 0, "functions": [], "classes": [], "imports": imports_of(text, language), "parsed_with": "regex", "comment_lines": 0}
    kind = lexing.ALIASES.get(language, language)
    if kind in lexing.KNOWN:
        name = {"c_sharp": "csharp", "tsx": "javascript"}.get(language, language)
        return islands.parse_islands(text, language, re.compile(_BRANCHING.get(name, _BRANCHING.get(kind, _ANY_BRANCH))))
    return parse_patterns(text, language)


def _parse_batches(batches):
    for pdf in batches:
        rows = []
        for path, language, content in zip(pdf["file_path"], pdf["language"], pdf["content"], strict=True):
            text = (content or "").replace("\r\n", "\n").replace("\r", "\n")
            rows.append({"file_path": path, "language": language, "loc": text.count("\n") + (text != "" and not text.endswith("\n"))} | parse(text, language))
        yield pd.DataFrame(rows, columns=[x.split()[0] for x in ("file_path s", "language s", "complexity i", "loc i", "comment_lines i", "functions a", "classes a", "imports a", "parsed_with s")])


def facts(files: DataFrame) -> DataFrame:
    """Facts of files(file_path, language, content), in Arrow batches, without a shuffle; ``parsed_with`` says how."""
    return files.select("file_path", F.coalesce("language", F.lit("text")).alias("language"), "content").mapInPandas(_parse_batches, OUT)
