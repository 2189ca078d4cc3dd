"""Functions, classes and imports among the tokens of a file; what lies between them is passed over.

Each language names its islands by a few tokens; brackets are matched once for the whole file, so that a head or a body is
skipped in one step. Closing brackets without an opening one are passed over, open ones end with their own line.
"""

from __future__ import annotations

import bisect
import re

from .lexing import ALIASES, Lexed, lex

#: Names before a bracket that are no function's.
NOT_NAMES = frozenset(
    ["if", "for", "while", "switch", "catch", "function", "return", "else", "do", "new", "throw", "synchronized", "try", "using", "lock", "foreach", "elseif", "with", "await", "typeof", "delete", "void", "case", "in", "of", "super", "this", "sizeof", "when", "match"]
    + ["fixed", "unless", "until", "import", "yield", "assert", "default", "where", "and", "or", "not", "require", "instanceof", "goto", "alignas", "decltype", "static_assert", "defined", "nameof", "checked", "unchecked"]
)
CLASS_WORDS = {
    "javascript": ["class", "interface", "enum"], "rust": ["struct", "enum", "trait", "impl", "union"], "java": ["class", "interface", "enum", "record"], "c": ["class", "struct", "enum", "union"], "csharp": ["class", "interface", "struct", "enum", "record"],
    "php": ["class", "interface", "trait", "enum"], "kotlin": ["class", "interface", "object"], "scala": ["class", "trait", "object"], "ruby": ["class", "module"], "go": ["type"],
}
FUNCTION_WORDS = {"javascript": "function", "go": "func", "rust": "fn", "php": "function", "kotlin": "fun", "scala": "def", "ruby": "def"}
_CLOSES = {")": "(", "]": "[", "}": "{"}
_TYPE_GOES_ON = frozenset([".", "<", ">", "|", "&", ",", "=>", "?", "::", "*"])


class Islands:
    def __init__(self, text: str, language: str):
        self.kind = ALIASES.get(language, language)
        self.c_like = language in ("c", "cpp")
        self.text = text
        self.read: Lexed = lex(text, language)
        self.k, self.v, self.at = self.read.kinds, self.read.values, self.read.starts
        self.n = len(self.k)
        self.lines = [m.start() for m in re.finditer("\n", text)]
        self.pairs = self._ends() if self.kind == "ruby" else self._brackets()
        self.functions: list[tuple[str, int, int]] = []  # (name, first token, last token)
        self.classes: list[tuple[str, int, int]] = []
        self.imports: list[str] = []
        self._read()

    # ---- places

    def line(self, offset: int) -> int:
        return bisect.bisect_left(self.lines, offset) + 1

    def value(self, i: int):
        """The token's text; None for a string or beyond the file."""
        return self.v[i] if 0 <= i < self.n and self.k[i] in "npd" else None

    def _brackets(self) -> dict[int, int]:
        pairs, held, open_ = {}, [], {"(": 0, "[": 0, "{": 0}
        for i in range(self.n):
            c = self.v[i]
            if self.k[i] != "p":
                continue
            if c in open_:
                held.append(i)
                open_[c] += 1
            elif c in _CLOSES and open_[_CLOSES[c]]:
                if c != "}" and self.v[held[-1]] != _CLOSES[c]:
                    continue
                while True:
                    j = held.pop()
                    open_[self.v[j]] -= 1
                    if self.v[j] == _CLOSES[c]:
                        pairs[j] = i
                        break
        return pairs

    def _ends(self) -> dict[int, int]:
        """Ruby: what each def, class, module, do and leading if ends with; and brackets, too."""
        pairs, held = self._brackets(), []
        self.pairs_of_brackets = pairs
        for i in range(self.n):
            word = self.value(i)
            if self.k[i] != "n" or self.value(i - 1) in (".", "::") or self.value(i + 1) == ":" and self.value(i + 2) != ":":
                continue
            first = i == 0 or self.line(self.at[i - 1]) < self.line(self.at[i]) or self.value(i - 1) in (";", "=", "(", "then", "else", "do", "{", "|")
            if word == "def" and self._endless(i):
                continue
            if word in ("def", "class", "module", "begin", "do", "case") or (word in ("if", "unless", "while", "until", "for") and first):
                loop = word == "do" and held and self.v[held[-1]] in ("while", "until", "for") and self.line(self.at[held[-1]]) == self.line(self.at[i])
                if not loop and not (word == "class" and self.value(i + 1) == "<" and self.value(i - 1) is None):
                    held.append(i)
            elif word == "end" and held:
                pairs[held.pop()] = i
        return pairs

    def _endless(self, i: int) -> bool:
        """Ruby: def name = expression, which has no end; name=(value) is no such one."""
        j = i + 1
        while self.value(j + 1) == ".":
            j += 2
        setter = self.value(j + 1) == "=" and self.at[j + 1] == self.read.ends[j] and self.value(j + 2) == "("
        if self.value(j + 1) == "(":
            j = self.pairs_of_brackets.get(j + 1, j + 1)
        return self.value(j + 1) == "=" and not setter and self.value(j + 2) not in ("=", "~")

    def close(self, i: int) -> int:
        """The token that ends the bracket at i; i itself where none does."""
        return self.pairs.get(i, i)

    def angle(self, i: int) -> int:
        """Past a list of type arguments that begins at i with <; i where none does or it never ends."""
        if self.value(i) != "<":
            return i
        depth, j = 0, i
        while j < self.n and j < i + 400:
            c = self.value(j)
            if c in ("(", "[", "{"):
                j = self.close(j)
            elif c == "<":
                depth += 1
            elif c == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif c == ";":
                return i
            j += 1
        return i

    def body(self, i: int, stops: tuple[str, ...] = (";", "}")) -> int | None:
        """The brace that opens a body at or after i; brackets on the way are passed over. None where the head ends without."""
        while i < self.n:
            c = self.value(i)
            if c == "{":
                return i
            if c in stops:
                return None
            i = self.close(i) + 1 if c in ("(", "[") else i + 1
        return None

    # ---- islands

    def _read(self) -> None:
        words, word = CLASS_WORDS.get(self.kind, []), FUNCTION_WORDS.get(self.kind)
        inside: list[int] = []  # braces around the token
        bodies: dict[int, str] = {}  # braces of classes, by name
        for i in range(self.n):
            c = self.v[i]
            if self.k[i] == "p":
                if c == "{" and i in self.pairs:
                    inside.append(i)
                elif c == "}" and inside and self.pairs[inside[-1]] == i:
                    inside.pop()
                continue
            if self.k[i] == "i":
                self.imports.append(c)
                continue
            if self.k[i] != "n":
                continue
            before = self.value(i - 1)
            if before in (".", "?.") or (before == "::" and c in words):
                continue
            if c in words:
                self._class(i, bodies)
            if c == word:
                self._function(i)
            elif self.kind == "javascript" or word is None:
                self._member(i, bodies.get(inside[-1]) if inside else None, bool(inside))
            self._import(i, bool(inside))

    def _class(self, i: int, bodies: dict[int, str]) -> None:
        kind, j = self.kind, i + 1
        if kind == "go":
            if self.value(i + 2) in ("struct", "interface") and self.k[i + 1] == "n":
                b = self.body(i + 2)
                self.classes.append((self.v[i + 1], i, self.close(b) if b is not None else i + 2))
            return
        if kind == "rust" and self.v[i] == "impl":
            j = self.angle(j)
            b = self.body(j)
            if b is None:
                return
            fors = [x for x in range(j, b) if self.value(x) == "for" and self.value(x + 1) != "<"]
            first = fors[0] + 1 if fors else j
            last = next((x for x in range(first, b) if self.value(x) == "where"), b)
            self.classes.append((" ".join(self.text[self.at[first] : self.at[last]].split()), i, self.close(b)))
            return
        if kind in ("c", "kotlin", "csharp", "java") and self.value(j) in ("class", "struct", "interface"):
            return  # enum class, record struct, and the like: the word after names it
        while self.value(j) == "[" or (self.c_like and self.value(j) in ("final", "alignas") and self.value(j + 1) == "("):
            j = self.close(j) + 1
        if j >= self.n or self.k[j] != "n" or self.v[j] in ("extends", "implements"):
            return
        if kind == "javascript" and self.v[i] in ("interface", "enum") and self.value(j + 1) not in ("{", "<", "extends"):
            return
        if kind == "java" and self.v[i] == "record" and self.value(j + 1) not in ("(", "<"):
            return
        if kind == "ruby":
            while self.value(j + 1) == "::":
                j += 2
            if self.v[i] in ("class", "module") and i in self.pairs:
                self.classes.append((self.v[j], i, self.close(i)))
            return
        if kind in ("kotlin", "scala"):
            b = self._kotlin_body(j + 1)
        elif self.c_like:
            b = next((x for x in [self.body(j + 1, (";", "}", "(", ")", ",", "=", "*", "&"))] if x is not None), None)
            if b is None:
                return  # a mention, not a definition
        else:
            b = self.body(j + 1)
        if b is not None:
            bodies[b] = self.v[j]
        self.classes.append((self.v[j], i, self.close(b) if b is not None else j))

    def _kotlin_body(self, i: int) -> int | None:
        """The brace of a declaration whose head may end with its line."""
        last = i - 1
        while i < self.n:
            c = self.value(i)
            fresh = self.line(self.at[i]) > self.line(self.at[last])
            if fresh and c not in ("{", ":", ",", "where", "(", ")", "extends", "with", "=") and self.value(last) not in (",", ":", "<", "(", "extends", "with"):
                return None
            if c == "{":
                return i
            if c in (";", "}", "="):
                return None
            j = self.close(i) if c in ("(", "[") else i
            last, i = j, j + 1
        return None

    def _function(self, i: int) -> None:
        """An island that begins with the language's word for a function."""
        kind, j = self.kind, i + 1
        if kind == "go" and self.value(j) == "(":
            j = self.close(j) + 1
        if kind in ("javascript", "php") and self.value(j) in ("*", "&"):
            j += 1
        if kind == "kotlin":
            j = self.angle(j)
            while self.k[j : j + 1] == ["n"] and (self.value(j + 1) in (".", "?.") or (self.value(j + 1) == "<" and self.value(self.angle(j + 1)) in (".", "?."))):
                j = (self.angle(j + 1) if self.value(j + 1) == "<" else j + 1) + 1
        if kind == "ruby":
            while self.value(j + 1) == "." and j + 2 < self.n:
                j += 2
        if j >= self.n or self.k[j] != "n" or self.v[j] == "(":
            return
        name = self.v[j].strip("`")
        if kind == "ruby":
            last = self.pairs.get(i)
            if last is None:
                last = next((x for x in range(j, self.n) if self.line(self.at[x]) > self.line(self.at[j])), self.n) - 1  # def name = expression
            self.functions.append((name, i, last))
            return
        params = self.angle(j + 1)
        if self.value(params) == "[" and kind in ("go", "scala"):
            params = self.close(params) + 1
        if self.value(params) != "(" and kind != "scala":
            return
        head = self.close(params) + 1 if self.value(params) == "(" else params
        while kind == "scala" and self.value(head) == "(":
            head = self.close(head) + 1
        if kind in ("kotlin", "scala"):
            end = self._expression_end(j, head)
        elif kind == "go":
            b = head
            while b < self.n and self.value(b) != "{" and self.line(self.at[b]) == self.line(self.at[head - 1]):
                b = self.close(b) + 1 if self.value(b) in ("(", "[") else b + 1
                while self.value(b) == "{" and self.value(b - 1) in ("interface", "struct"):
                    b = self.close(b) + 1
            end = self.close(b) if self.value(b) == "{" else head - 1
        else:
            b = self.body(self._type_end(head)) if kind == "javascript" else self.body(head)
            if b is None:
                if kind == "javascript":
                    return  # an overload or a declaration without a body
                end = next((x for x in range(head, self.n) if self.value(x) in (";", "}")), head - 1)
            else:
                end = self.close(b)
        self.functions.append((name, i, end))

    def _expression_end(self, name: int, i: int) -> int:
        """Kotlin, Scala: a body in braces, or = and an expression to the end of the line where all brackets are closed."""
        last = i - 1
        while i < self.n:
            c = self.value(i)
            if c == "{":
                return self.close(i)
            if c == "=":
                if self.value(i + 1) == "{":
                    return self.close(i + 1)
                last, i = i, i + 1
                while i < self.n and (self.line(self.at[i]) == self.line(self.at[last]) or self.value(last) in ("=", ".", "+", "->") or self.value(i) in (".", "?.")) and self.value(i) not in ("}", ";", ")"):
                    last = self.close(i) if self.value(i) in ("(", "[", "{") else i
                    i = last + 1
                return last
            if c in (";", "}") or (self.line(self.at[i]) > self.line(self.at[last]) and c not in (":", "where")):
                return last
            last = self.close(i) if c in ("(", "[") else i
            i = last + 1
        return last

    def _type_end(self, i: int) -> int:
        """Past a result type in TypeScript, at what follows it; a brace of an object type is passed over."""
        if self.value(i) != ":":
            return i
        i, expects = i + 1, True
        while i < self.n:
            c = self.value(i)
            if c == "{" and not expects:
                return i
            if c in ("{", "(", "["):
                i, expects = self.close(i) + 1, False
            elif c == "<":
                j = self.angle(i)
                i, expects = (j, False) if j > i else (i + 1, True)
            elif c in _TYPE_GOES_ON or c in ("is", "keyof", "typeof", "extends", "infer", "readonly", "unique", "asserts"):
                i, expects = i + 1, True
            elif expects and self.k[i] in "nsd":
                i, expects = i + 1, False
            else:
                return i
        return i

    def _member(self, i: int, owner: str | None, inside: bool) -> None:
        """name ( ... ) { ... } without a word for functions: methods, constructors, and functions with a type before their name."""
        name, before = self.v[i], self.value(i - 1)
        params = self.angle(i + 1)
        if name in NOT_NAMES or self.value(params) != "(" or params not in self.pairs or (before == "::" and self.kind != "c") or before in (*CLASS_WORDS[self.kind], "new", "function", "@", "->", "=>", "=", "return", "throw", "case", "await", "yield"):
            return
        head = self.close(params) + 1
        if self.kind == "javascript":
            if not inside or (before == "?" or (self.k[i - 1] == "n" and before not in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "accessor", "declare") and self.line(self.at[i - 1]) == self.line(self.at[i]))):
                return
            b = self._type_end(head)
            if self.value(b) == "{":
                self.functions.append((name, i, self.close(b)))
            return
        typed = before is not None and (before in (">", "]", "*", "&", "?", "~") or (self.k[i - 1] == "n" and (before == "void" or before not in NOT_NAMES)))
        begin = i
        while begin > 0 and self.value(begin - 1) not in ("{", "}", ";") and self.k[begin - 1] != "i":
            j = begin - 1
            if self.value(j) in ("=", ".", "->", "=>") and self.kind != "c":
                return  # part of an expression
            if self.value(j) == ")":
                a = self.opening(j) - 1
                while self.value(a - 1) == ".":
                    a -= 2
                if self.kind == "c":
                    break
                if self.value(a - 1) != "@":
                    return  # a call, not an annotation
                j = a - 1
            begin = j
        if self.kind == "c":
            while self.value(head) in ("const", "noexcept", "override", "final", "volatile", "&"):
                head += 1
            b = self.body(head, (";", "}", "=", ",", ")")) if self.value(head) in (":", "->") else head
            if (typed or owner == name or before in ("::", "~")) and self.value(b) == "{":
                self.functions.append((name, begin if self.line(self.at[begin]) >= self.line(self.at[i]) - 5 else i, self.close(b)))
            return
        if not (typed or owner == name):
            return
        while head < self.n and self.value(head) not in ("{", ";", "=>", "}") and (self.k[head] == "n" or self.value(head) in (",", ".", "<", ">", "[", "]", "(", ":", "@")):
            head = self.close(head) + 1 if self.value(head) in ("(", "[") else head + 1
        c = self.value(head)
        if c == "{":
            self.functions.append((name, begin, self.close(head)))
        elif owner is not None and (c == ";" or c == "=>"):
            self.functions.append((name, begin, head if c == ";" else next((x for x in range(head, self.n) if self.value(x) == ";"), head)))

    def opening(self, j: int) -> int:
        if not hasattr(self, "_opened"):
            self._opened = {b: a for a, b in self.pairs.items()}
        return self._opened.get(j, j)

    # ---- imports

    def _import(self, i: int, inside: bool) -> None:
        c, kind = self.v[i], self.kind
        if kind == "javascript":
            if c == "import" and self.value(i + 1) != ".":
                j = i + 1
                while j < self.n and self.k[j] in "np" and self.v[j] not in (";", "=", "import"):
                    if self.value(j) == "(" and j > i + 1:
                        return
                    j += 1
                if j < self.n and self.k[j] == "s" and self.v[j] is not None and (j == i + 1 or self.value(j - 1) in ("from", "(")):
                    self.imports.append(self.v[j])
            elif c == "export" and self.value(i + 1) in ("*", "{", "type"):
                j = i + 1 + (self.value(i + 1) == "type")
                j = self.close(j) + 1 if self.value(j) == "{" else j + 1
                while self.value(j) == "as" or self.value(j - 1) == "as":
                    j += 1
                if self.value(j) == "from" and self.k[j + 1 : j + 2] == ["s"] and self.v[j + 1]:
                    self.imports.append(self.v[j + 1])
            elif c == "require" and self.value(i + 1) == "(" and self.k[i + 2 : i + 3] == ["s"] and self.v[i + 2]:
                self.imports.append(self.v[i + 2])
        elif kind == "go" and c == "import" and not inside:
            j, last = i + 1, i + 3
            if self.value(j) == "(":
                last = self.close(j)
            self.imports += [self.v[x] for x in range(j, min(last, self.n)) if self.k[x] == "s" and self.v[x]][: None if self.value(j) == "(" else 1]
        elif kind == "rust" and c == "use":
            self._uses(i + 1, "")
        elif c == "import" and kind in ("java", "kotlin", "scala") and not (inside and kind == "java"):
            j = i + 1 + (self.value(i + 1) == "static")
            self._dotted(j, ".", "*_")
        elif kind == "csharp" and c == "using" and self.value(i + 1) not in ("(", "var"):
            j = i + 1 + (self.value(i + 1) == "static")
            j += 2 if self.value(j + 1) == "=" else 0
            before = len(self.imports)
            end = self._dotted(j, ".", "")
            if self.value(end) != ";":
                del self.imports[before:]
        elif kind == "php":
            if c == "use" and self.value(i - 1) != ")" and not inside:
                j = i + 1 + (self.value(i + 1) in ("function", "const"))
                self._dotted(j, "\\", "")
            elif c.lower() in ("require", "require_once", "include", "include_once"):
                j = i + 1 + (self.value(i + 1) == "(")
                if self.k[j : j + 1] == ["s"] and self.v[j]:
                    self.imports.append(self.v[j])
        elif kind == "ruby" and c in ("require", "require_relative", "load"):
            j = i + 1 + (self.value(i + 1) == "(")
            if self.k[j : j + 1] == ["s"] and self.v[j]:
                self.imports.append(("./" if c == "require_relative" and not self.v[j].startswith(".") else "") + self.v[j])

    def _dotted(self, i: int, dot: str, tails: str) -> int:
        """A dotted name from i on goes to the imports; a tail of * is left out, a group gives one name each. Past its end."""
        name = ""
        if self.value(i) == dot:
            i += 1
        while i < self.n and self.k[i] == "n" and self.v[i] not in tails:
            name += self.v[i].strip("`")
            if self.value(i + 1) != dot:
                i += 1
                break
            name, i = name + dot, i + 2
            if self.value(i) == "{" or self.value(i) == "*" or self.value(i) == "_":
                break
        if self.value(i) == "{" and name:
            last = self.close(i)
            x = i + 1
            while x < last:
                if self.k[x] == "n":
                    self.imports.append(name + self.v[x])
                    while x < last and self.value(x) != ",":
                        x += 1
                x += 1
            return last + 1
        if name.strip(dot):
            self.imports.append(name.rstrip(dot))
        return i

    def _uses(self, i: int, prefix: str) -> int:
        """A use tree of Rust: each of its leaves by its whole path. Where it ends."""
        name = prefix
        while i < self.n:
            c = self.value(i)
            if c == "{":
                last, x = self.close(i), i + 1
                while x < last:
                    x = self._uses(x, name) + 1
                return last + 1
            if c == "*" or (c == "self" and prefix):
                self.imports.append(name.rstrip(":"))
                i += 1
            elif self.k[i] == "n" and c != "as":
                name += c
                i += 1
                if self.value(i) == "::":
                    name, i = name + "::", i + 1
                    continue
                self.imports.append(name)
            elif c == "::":
                i += 1
                continue
            while i < self.n and self.value(i) not in (",", ";", "}"):
                i += 1
            return i
        return i


def parse_islands(text: str, language: str, branch: re.Pattern) -> dict:
    """Facts of a file in a language of braces, or of Ruby: as in ``parsing.facts``; imports sorted, each once."""
    found = Islands(text, language)
    marks = [m.start() for m in branch.finditer(found.read.bare)]
    ends = found.read.ends

    def row(name: str, first: int, last: int) -> dict:
        a, b = found.at[first], ends[max(first, last)] - 1
        lines = found.line(a), found.line(b)
        return {"name": name, "start_line": lines[0], "end_line": lines[1], "complexity": 1 + bisect.bisect_right(marks, b) - bisect.bisect_left(marks, a), "lines": lines[1] - lines[0] + 1}

    functions = [row(*f) for f in found.functions]
    return {
        "complexity": 1 + len(marks), "parsed_with": "lexer", "imports": sorted({x for x in found.imports if x.strip()}), "comment_lines": found.read.comments,
        "functions": sorted(functions, key=lambda f: (f["start_line"], f["name"])), "classes": [{k: r[k] for k in ("name", "start_line", "end_line")} for r in (row(*c) for c in found.classes)],
    }
