"""Proposed diffs: cleaned, anchored to the file they mean, checked by applying them."""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X

_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@(.*)$")


def clean(diff: str) -> str:
    """Without fences and prose; each hunk's counts are those of its lines. Empty where there is no hunk."""
    lines = [x for x in diff.replace("\r\n", "\n").split("\n") if not x.startswith("```")]
    start = next((i for i, x in enumerate(lines) if x.startswith(("--- ", "diff --git"))), None)
    if start is None or not any(x.startswith("@@") for x in lines):
        return ""
    out, i = [], start
    while i < len(lines):
        if not lines[i].startswith("@@"):
            if lines[i].startswith(("--- ", "+++ ", "diff ", "index ", "new file", "deleted file")):
                out.append(lines[i])
            i += 1
            continue
        body, j = [], i + 1
        while j < len(lines) and not lines[j].startswith(("@@", "--- ", "diff ")):
            if lines[j] == "" or lines[j][0] in " +-\\":
                body.append(lines[j] or " ")
            j += 1
        while body and body[-1] == " " and j >= len(lines):
            body.pop()
        m = _HUNK.match(lines[i])
        old, new = sum(x[0] in " -" for x in body), sum(x[0] in " +" for x in body)
        a, b, tail = (m[1], m[3], m[5]) if m else ("1", "1", "")
        out += [f"@@ -{a},{old} +{b},{new} @@{tail}", *body]
        i = j
    return "\n".join(out) + "\n"


def unsafe(diff: str) -> bool:
    """``exprs.unsafe_diff`` of a diff at hand."""
    for line in diff.split("\n"):
        if m := re.match(r"(?:---|\+\+\+) ([^\t\r]*)", line):
            path = re.sub(r"^[ab]/", "", m[1])
            if path != "/dev/null" and (path.startswith("/") or re.search(r"(^|/)\.\.(/|$)|(^|/)\.git/", path)):
                return True
    return False


def hunks(diff: str) -> list[tuple[int, list[str]]]:
    out: list[tuple[int, list[str]]] = []
    for x in diff.split("\n"):
        if m := _HUNK.match(x):
            out.append((int(m[1]), []))
        elif out and x[:1] in (" ", "+", "-"):
            out[-1][1].append(x)
    return out


def _find(lines: list[str], block: list[str], near: int) -> int:
    """The place where the block stands, the nearest to ``near``; -1 for none. Ends of lines don't count."""
    bare, want = [x.rstrip() for x in lines], [x.rstrip() for x in block]
    places = [i for i in range(len(bare) - len(want) + 1) if bare[i : i + len(want)] == want]
    return min(places, key=lambda i: (abs(i - near), i), default=-1)


def apply(source: str, diff: str, strict: bool = False) -> tuple[str | None, str]:
    """(the patched text, '') or (None, why not); strict asks for the hunk's own line."""
    lines, shift = source.split("\n"), 0
    for start, body in hunks(diff):
        old, new = [x[1:] for x in body if x[0] in " -"], [x[1:] for x in body if x[0] in " +"]
        at = start - 1 + shift
        if strict and [x.rstrip() for x in lines[at : at + len(old)]] != [x.rstrip() for x in old]:
            return None, f"hunk at line {start} does not apply"
        if not strict:
            at = _find(lines, old, at) if old else min(max(at, 0), len(lines))
        if at < 0:
            return None, f"hunk at line {start} has no place"
        lines[at : at + len(old)] = new
        shift += len(new) - len(old)
    return ("\n".join(lines), "") if hunks(diff) else (None, "no hunks")


def _changes(body: list[str]) -> list[tuple[list[str], list[str]]]:
    """(removed, added) of each run of changes in a hunk, context left out."""
    runs, open_ = [], False
    for x in body:
        if x[0] == " ":
            open_ = False
        elif not open_ or (x[0] == "-" and runs[-1][1]):
            runs.append(([x[1:]], []) if x[0] == "-" else ([], [x[1:]]))
            open_ = True
        else:
            runs[-1][x[0] == "+"].append(x[1:])
    return runs


class _Places:
    """Where blocks of lines stand in a file; lines that one change took are no place for another."""

    def __init__(self, lines: list[str]):
        self.lines, self.taken, self.first = [x.rstrip() for x in lines], set(), {}
        for i, x in enumerate(self.lines):
            self.first.setdefault(x, []).append(i)

    def of(self, block: list[str]) -> list[int]:
        want = [x.rstrip() for x in block]
        return [i for i in self.first.get(want[0], []) if self.lines[i : i + len(want)] == want and self.taken.isdisjoint(range(i, i + len(want)))] if want else []


def _placed(places: _Places, start: int, body: list[str]) -> list[tuple[int, list[str], list[str]]] | None:
    """(line, removed, added) of a hunk's changes in the file, or None.

    Where its context is the file's, the hunk stands there, at its own line or as near to it as can be. Else context is
    not asked for: the removed lines as one block, wherever they stand first; or run by run, where each stands once.
    """
    runs, old = _changes(body), [x[1:] for x in body if x[0] in " -"]
    exact = min(places.of(old), key=lambda i: (abs(i - start + 1), i), default=None)
    if exact is not None:
        out, at = [], exact
        k, before = 0, " "
        for x in body:
            if x[0] != " " and (before == " " or (x[0] == "-" and before == "+")):
                out.append((at, *runs[k]))
                k += 1
            at, before = at + (x[0] != "+"), x[0]
        return out
    removed, added = [x[1:] for x in body if x[0] == "-"], [x[1:] for x in body if x[0] == "+"]
    if removed and (found := places.of(removed)):
        return [(found[0], removed, added)]
    spots = [places.of(r) for r, _ in runs]
    return [(s[0], *run) for s, run in zip(spots, runs, strict=True)] if all(len(s) == 1 for s in spots) else None


def reanchor(source: str, diff: str, path: str) -> str:
    """The same change with the file's own lines around it; empty where a change has no place, or changes nothing.

    Hunks are placed by falling number of removed lines, so that a short block does not take a line that a longer one
    needs, then written into the file from its end on; the diff of the two gives numbers and context. Its own output
    comes back as it is.
    """
    lines = source.split("\n")
    places, found = _Places(lines), []
    for start, body in sorted(hunks(diff), key=lambda h: -sum(x[0] == "-" for x in h[1])):
        spots = _placed(places, start, body)
        if not spots:
            return ""
        for at, removed, added in spots:
            found.append((at, len(removed), added))
            places.taken.update(range(at, at + len(removed)))
    after = list(lines)
    for at, n, added in sorted(found, key=lambda f: f[:2], reverse=True):
        after[at : at + n] = added
    if after == lines:
        return ""
    return "\n".join(difflib.unified_diff(lines, after, f"a/{path}", f"b/{path}", n=3, lineterm="")) + "\n"


def _check(batches):
    for pdf in batches:
        rows = []
        for path, content, raw in zip(pdf["file_path"], pdf["content"], pdf["diff"], strict=True):
            cleaned = clean(raw or "")
            fixed = reanchor(content or "", cleaned, path) if cleaned else ""
            _, why = apply(content or "", fixed, strict=True) if fixed else (None, "no usable diff")
            rows.append((path, fixed or cleaned, why == "", why))
        yield pd.DataFrame(rows, columns=["file_path", "diff", "applies", "reason"])


def check(proposals: DataFrame, files: DataFrame) -> DataFrame:
    """file_path, diff, applies, reason of proposals(file_path, diff); diffs that name unsafe paths are refused unread."""
    bad = proposals.filter(X.unsafe_diff(F.col("diff"))).select("file_path", "diff", F.lit(False).alias("applies"), F.lit("unsafe path").alias("reason"))
    good = proposals.filter(~X.unsafe_diff(F.col("diff"))).join(files.select("file_path", "content"), "file_path")
    return good.select("file_path", "content", "diff").mapInPandas(_check, "file_path string, diff string, applies boolean, reason string").unionByName(bad)
