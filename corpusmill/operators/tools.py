"""Look-ups that an assistant may call, the bounded loop that lets it, and answers that must be JSON.

A conversation runs on the driver; what it looks up are queries over tables.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import graph, search

# The look-ups' names and arguments, and limits in characters, hits and files.
READ, HITS, SEARCHED_FILES, PREVIEW, PAYLOAD = 8_000, 25, 400, 400, 20_000
SCHEMAS = [
    {"name": "read_file", "required": ["path"], "properties": {"path": "string"}},
    {"name": "search_code", "required": ["query"], "properties": {"query": "string", "max_results": "integer"}},
    {"name": "list_dependencies_of_file", "required": ["path"], "properties": {"path": "string"}},
]
WRAP_UP = "Answer in prose from the results above and call nothing more; say what is missing."


class Tools:
    """The look-ups over one repository's files(file_path, content, ...metrics) and edges(source, target). None of them raises."""

    def __init__(self, files: DataFrame, edges: DataFrame):
        self.files, self.edges, self.calls = files, edges, []

    def execute(self, name: str, arguments: dict) -> dict:
        known = {"read_file": self.read_file, "search_code": self.search_code, "list_dependencies_of_file": self.list_dependencies}
        if name not in known:
            return {"error": f"unknown tool: {name}"}
        self.calls.append({"name": name, "arguments": arguments})
        try:
            return known[name](arguments)
        except Exception as e:  # noqa: BLE001  a failure is an answer
            return {"error": str(e)[:300]}

    def read_file(self, arguments: dict) -> dict:
        path = str(arguments.get("path", "")).strip()
        if not path:
            return {"error": "path is required"}
        row = search.read_file(self.files, path, READ).first()
        if row is None or not row.content:
            return {"error": f"could not read {path}"}
        metrics = self.files.filter(F.col("file_path") == path).drop("content").first().asDict(recursive=True)
        return {"path": path, "content": row.content, "lines": row.lines, "truncated": row.truncated, "metrics": metrics}

    def search_code(self, arguments: dict) -> dict:
        query = str(arguments.get("query", "")).strip()
        if not query:
            return {"error": "query is required"}
        try:
            most = max(1, min(HITS, int(arguments.get("max_results") or HITS)))
        except (TypeError, ValueError):
            most = HITS
        some = self.files.orderBy("ord").limit(SEARCHED_FILES) if "ord" in self.files.columns else self.files
        found = search.search_code(some, query, most, READ).collect()
        return {"query": query, "matches": [r.asDict() for r in found], "truncated": len(found) >= most}

    def list_dependencies(self, arguments: dict) -> dict:
        path = str(arguments.get("path", "")).strip()
        row = graph.dependents(self.edges).filter(F.col("node") == path).first()
        if row is not None:
            return {"path": path, "dependencies": row.dependencies, "dependents": row.dependents}
        if self.files.filter(F.col("file_path") == path).limit(1).count():
            return {"path": path, "dependencies": [], "dependents": []}
        return {"error": f"{path} is not known", "known": [r.file_path for r in self.files.select("file_path").orderBy("file_path").limit(20).collect()]}


@dataclass
class Turn:
    """What a model says: a text, or calls of tools (name, JSON arguments)."""

    text: str = ""
    calls: list[tuple[str, str]] = field(default_factory=list)


def loop(messages: list[dict], model: Callable[[list[dict], bool], Turn], execute: Callable[[str, dict], object], rounds: int = 6) -> tuple[str, list[dict]]:
    """(answer, records): the model is asked up to ``rounds`` times with tools, then once more without.

    model(messages, tools allowed). Arguments that aren't an object become one; what a tool raises is its result. A
    final text that is itself a call of a tool is not an answer, and the answer says so.
    """
    said, records = list(messages), []
    for _ in range(max(1, rounds)):
        turn = model(said, True)
        if not turn.calls:
            return turn.text, records
        said.append({"role": "assistant", "content": turn.text or None, "calls": list(turn.calls)})
        for name, raw in turn.calls:
            try:
                arguments = json.loads(raw or "{}")
            except ValueError:
                arguments = {}
            if not isinstance(arguments, dict):
                arguments = {"input": arguments}
            try:
                result = execute(name, arguments)
            except Exception as e:  # noqa: BLE001  a failure is a result
                result = {"error": str(e)[:300]}
            payload = result if isinstance(result, str) else json.dumps(result, default=str)
            records.append({"name": name, "arguments": arguments, "result_preview": payload[:PREVIEW]})
            said.append({"role": "tool", "content": payload[:PAYLOAD]})
    said.append({"role": "user", "content": WRAP_UP})
    text = model(said, False).text
    if is_call(text):
        text = f"All {max(1, rounds)} rounds of look-ups were used without an answer."
    return text, records


def is_call(text: str, names: tuple[str, ...] = tuple(s["name"] for s in SCHEMAS)) -> bool:
    """``exprs.is_tool_call_text`` of a text at hand."""
    return bool(re.search(X.CALL_MARKUP, text or "")) or any(re.search(X.called(n), text or "") for n in names)


def messages(system: str, context: str, history: list[dict], question: str, most: int = 10) -> list[dict]:
    """The system text, the context as a second one, the last turns and the question."""
    head = [{"role": "system", "content": system}, *([{"role": "system", "content": context}] if context else [])]
    return [*head, *[{"role": t["role"], "content": t["content"]} for t in history[-most:] if t.get("content")], {"role": "user", "content": question}]


def json_answer(model: Callable[[str, bool], str], prompt: str, attempts: int = 3) -> tuple[object, int]:
    """(value, calls): asks for JSON, first under a schema, then without, until one can be read out of the text; ValueError if none can.

    model(prompt, schema asked for). An error of the first call drops the schema, not the attempt.
    """
    asked, strict = prompt + "\nAnswer in JSON only.", True
    for k in range(attempts):
        try:
            text = model(asked, strict)
        except ValueError:
            text = ""
        value = recover(text)
        if value is not None:
            return value, k + 1
        strict = False
    raise ValueError("no JSON in the answers")


def recover(text: str) -> object | None:
    """``exprs.extract_json`` of a text at hand; None where nothing parses."""
    bare = (text or "").strip()
    m = re.search(X.FENCE, bare)
    inner = m[1].strip() if m else bare
    starts = sorted(i for i in (inner.find("{"), inner.find("[")) if i >= 0)
    for shape in (bare, inner, *[X.scan_balanced(inner, i) for i in starts]):
        mended = shape
        for pattern, value in X.REPAIRS:
            mended = re.sub(pattern.replace("(?dm)", "(?m)"), value.replace("$1", r"\1"), mended)
        for attempt in (shape, mended.strip()):
            try:
                if attempt and (found := json.loads(attempt)) is not None:
                    return found
            except ValueError:
                continue
    return None


def chat(question: str, context: str, tools: Tools, model: Callable[[list[dict], bool], Turn], history: list[dict] | None = None, rounds: int = 6) -> dict:
    """answer, tool records, and the files that tools read, in order."""
    text, records = loop(messages("Answer from this repository alone.", context, history or [], question), model, tools.execute, rounds)
    read = [r["arguments"].get("path", "") for r in records if r["name"] == "read_file"]
    return {"answer": text, "records": records, "read": list(dict.fromkeys(p for p in read if p))}
