"""Source text as tokens, for languages with braces and for Ruby: strings, templates, comments and regexes told apart.

A token is (kind, value, start, end). Kinds: n name, d number, s string (value: what is between the quotes, None where
something is interpolated), x regex, i included header, p anything else. One pass, linear in the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

#: Languages that read like another one.
ALIASES = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript", "c_sharp": "csharp", "cpp": "c"}
#: Those with a lexer here.
KNOWN = frozenset(["javascript", "go", "rust", "java", "c", "csharp", "php", "kotlin", "scala", "ruby"])

_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_CHAR = r"'(?:\\[^\n']*'|\\'[^\n]*?'|[^'\\\n]')"
#: Whole strings, by language; what holds code inside is in _OPENERS.
_STRINGS = {
    "javascript": rf"{_QUOTED}|{_SINGLE}", "go": rf"`[^`]*`|{_QUOTED}|{_CHAR}", "rust": rf'b?r(?P<h>#*)"[\s\S]*?"(?P=h)|b?"(?:\\[\s\S]|[^"\\])*"|b?{_CHAR}', "java": rf'"""(?:\\[\s\S]|(?!""")[\s\S])*"""|{_QUOTED}|{_CHAR}',
    "c": rf'(?:u8|[uUL])?R"(?P<h>[^\s()\\]{{0,16}})\([\s\S]*?\)(?P=h)"|(?:u8|[uUL])?{_QUOTED}|{_CHAR}', "csharp": rf'@"(?:""|[^"])*"|{_QUOTED}|{_CHAR}', "php": r"'(?:\\[\s\S]|[^'\\])*'", "kotlin": _CHAR, "scala": _CHAR,
    "ruby": rf"{_SINGLE}|%[wWiI]?(?:\[[^\]]*\]|\([^)]*\)|\{{[^}}]*\}})",
}
#: (opening, closing, what begins code inside, whether a line's end closes it), by language.
_OPENERS = {
    "javascript": [("`", "`", "${", False)], "kotlin": [('"""', '"""', "${", False), ('"', '"', "${", True)], "scala": [('"""', '"""', "${", False), ('"', '"', "${", True)],
    "csharp": [('$@"', '"', "{", False), ('@$"', '"', "{", False), ('$"', '"', "{", True)], "php": [('"', '"', "{$", False)], "ruby": [('"', '"', "#{", False), ("`", "`", "#{", False)],
}
_REGEX = r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*"
#: After these a slash begins a regex.
_BEFORE_REGEX = frozenset(["return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "and", "or", "not", "if", "unless", "while", "when", "then"])
_NESTED = frozenset(["rust", "kotlin", "scala"])


@dataclass
class Lexed:
    kinds: list[str]
    values: list
    starts: list[int]
    ends: list[int]
    #: The text with comments, strings and regexes blanked, line ends kept; of the same length.
    bare: str
    comments: int


@lru_cache(maxsize=16)
def _plain(language: str) -> re.Pattern:
    comment = {"ruby": r"#[^\n]*|(?m:^=begin\b)[\s\S]*?(?:(?m:^=end\b[^\n]*)|\Z)", "php": r"//[^\n]*|#(?!\[)[^\n]*"}.get(language, r"//[^\n]*")
    openers = "|".join(re.escape(o[0]) for o in _OPENERS.get(language, []))
    here = {"ruby": r"<<[~-]?(?P<q>['\"]?)(?P<id>[A-Z_]\w*)(?P=q)", "php": r"<<<[ \t]*(?P<q>['\"]?)(?P<id>[A-Za-z_]\w*)(?P=q)"}.get(language)
    parts = [
        r"(?P<ws>\s+)", rf"(?P<comment>{comment})", r"(?P<block>/\*)" if language != "ruby" else None, r"(?P<i>#[ \t]*include[ \t]*(?:<[^>\n]+>|\"[^\"\n]+\"))" if language == "c" else None,
        r"(?P<directive>#[ \t]*(?:define|undef|if|ifdef|ifndef|elif|else|endif|pragma|error|warning|line)\b(?:\\\r?\n|[^\n])*)" if language == "c" else None, rf"(?P<here>{here})" if here else None, r"(?P<life>'[A-Za-z_]\w*(?!'))" if language == "rust" else None, rf"(?P<open>{openers})" if openers else None, rf"(?P<s>{_STRINGS[language]})",
        r"(?P<n>[#@]?[^\W\d][\w$]*[?!]?)" if language == "ruby" else r"(?P<n>#?[^\W\d][\w$]*|\$[\w$]*)" if language in ("javascript", "php") else r"(?P<n>r#[^\W\d]\w*|[^\W\d]\w*)", r"(?P<d>\d[\w.]*)",
        r"(?P<p>=>|->|::|\?\.|\?\?|\.\.\.|[\s\S])",
    ]
    return re.compile("|".join(p for p in parts if p))


@lru_cache(maxsize=64)
def _inside(close: str, code: str, one_line: bool) -> re.Pattern:
    double = r'\{\{|' if code == "{" else ""
    return re.compile(rf"(?:{double}\\[\s\S]|(?!{re.escape(close)}|{re.escape(code)})[{'^' + chr(92) + 'n' if one_line else chr(92) + 's' + chr(92) + 'S'}])*")


def _block_end(text: str, at: int, nested: bool) -> int:
    if not nested:
        end = text.find("*/", at + 2)
        return len(text) if end < 0 else end + 2
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m[0] == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def lex(text: str, language: str) -> Lexed:
    """The tokens of a text. What is never closed ends with its line or with the text; nothing raises."""
    language = ALIASES.get(language, language)
    plain, openers = _plain(language), {o[0]: o for o in _OPENERS.get(language, [])}
    kinds, values, starts, ends, blanks, comments = [], [], [], [], [], 0
    at, size, depth, within, awaited = 0, len(text), 0, [], []  # within: (opener, depth) of strings whose code is being read

    def add(kind: str, value, a: int, b: int) -> None:
        kinds.append(kind)
        values.append(value)
        starts.append(a)
        ends.append(b)

    def string(opener: tuple, begun: int, at: int, whole: bool) -> int:
        """Reads on inside a string from ``at``: to its end, or to the code in it."""
        nonlocal depth
        _, close, code, one_line = opener
        stop = _inside(close, code, one_line).match(text, at).end()
        if text.startswith(code, stop):
            add("s", None, begun, stop)
            blanks.append((begun, stop + len(code)))
            within.append((opener, depth))
            depth = 0
            return stop + len(code)
        end = stop + (len(close) if text.startswith(close, stop) else 0)
        add("s", text[at:stop] if whole else None, begun, end)
        blanks.append((begun, end))
        return end

    while at < size:
        m = plain.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind in ("h", "id", "q"):
            kind = "here" if "here" in m.re.groupindex and m["here"] else "s"
        if kind == "ws":
            if awaited and (line := text.find("\n", at, end)) >= 0:
                for name in awaited:  # the bodies of here-documents begin with the next line
                    close = re.compile(rf"^[ \t]*{name}\b", re.M).search(text, line + 1)
                    end = size if close is None else close.end()
                    blanks.append((line + 1, end))
                    line = end
                awaited = []
        elif kind == "comment" or kind == "block":
            end = end if kind == "comment" else _block_end(text, at, language in _NESTED)
            comments += 1
            blanks.append((at, end))
        elif kind == "directive":
            blanks.append((at, end))
        elif kind == "here":
            awaited.append(m["id"])
            add("s", None, at, end)
            blanks.append((at, end))
        elif kind == "open":
            end = string(openers[m["open"]], at, end, True)
        elif kind == "s":
            body = re.sub(r"^[a-zA-Z0-9@%#]*(?:\"\"\"|[\"'`\[({])|(?:\"\"\"|[\"'`\])}])#*$", "", m["s"])
            add("s", body, at, end)
            blanks.append((at, end))
        elif kind == "i":
            add("i", re.search(r"[<\"]([^>\"]+)", m["i"])[1], at, end)
        elif kind in ("n", "d", "life"):
            add("n" if kind == "n" else "d", m[0], at, end)
        else:
            c = m[0]
            if c == "/" and language in ("javascript", "ruby"):
                last = values[-1] if values else None
                expects = not kinds or (kinds[-1] == "p" and last not in (")", "]", "}")) or (kinds[-1] == "n" and last in _BEFORE_REGEX)
                r = re.compile(_REGEX).match(text, at) if expects else None
                if r:
                    add("x", None, at, r.end())
                    blanks.append((at, r.end()))
                    at = r.end()
                    continue
            if c == "}" and within and not depth:
                opener, depth = within.pop()
                at = string(opener, at, end, False)
                continue
            depth += (c == "{") - (c == "}")
            add("p", c, at, end)
        at = end
    pieces, last = [], 0
    for a, b in blanks:
        pieces += [text[last:a], re.sub(r"[^\n]", " ", text[a:b])]
        last = b
    return Lexed(kinds, values, starts, ends, "".join(pieces) + text[last:], comments)
