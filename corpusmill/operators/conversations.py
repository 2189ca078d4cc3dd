"""Conversations as tables: all that are open take a turn together, their calls are answered by joins, and those that have an answer leave.

One round is one question to the model for every open conversation, and one join for each kind of look-up; nothing of a
conversation goes through the driver, which only learns whether any is still open.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import held
from .tools import HITS, PAYLOAD, PREVIEW, READ, SCHEMAS, SEARCHED_FILES, WRAP_UP, Turn

CALLS = "array<struct<name:string,arguments:string>>"
SAID = "array<struct<role:string,content:string>>"
RECORDS = "array<struct<name:string,arguments:string,result_preview:string>>"
NAMES = [s["name"] for s in SCHEMAS]
#: model(open(conv_id, said), number of the round, whether it may call) -> (conv_id, text, calls)
Model = Callable[[DataFrame, int, bool], DataFrame]


def scripted(turns: DataFrame) -> Model:
    """A model that says turns(conv_id, round, text, calls) given beforehand; where there is none it says nothing."""
    return lambda open_, number, allowed: turns.filter(F.col("round") == number).select("conv_id", "text", F.col("calls") if allowed else F.lit(None).cast(CALLS).alias("calls"))


def asked(function: Callable[[list[dict], bool], Turn]) -> Model:
    """A model that is a function of the messages so far, called in Arrow batches on the executors; what it raises is an empty answer."""

    def model(open_: DataFrame, number: int, allowed: bool) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for conv, said in zip(pdf["conv_id"], pdf["said"], strict=True):
                    try:
                        turn = function([{"role": m["role"], "content": m["content"]} for m in said], allowed)
                    except Exception:  # noqa: BLE001  a failure is an answer without words
                        turn = Turn()
                    rows.append((conv, turn.text, [{"name": n, "arguments": a} for n, a in turn.calls] if allowed else None))
                yield pd.DataFrame(rows, columns=["conv_id", "text", "calls"])

        return open_.select("conv_id", "said").mapInPandas(run, f"conv_id {dict(open_.dtypes)['conv_id']}, text string, calls {CALLS}")

    return model


def parsed_arguments(raw: Column) -> Column:
    """Arguments as a JSON object: what is none becomes {"input": ...}, what is no JSON becomes {}."""
    value = F.try_parse_json(F.when(F.btrim(F.coalesce(raw, F.lit(""))) == "", "{}").otherwise(raw))
    kind = F.schema_of_variant(value)
    return F.when(value.isNull(), "{}").when(F.startswith(kind, F.lit("OBJECT")), F.to_json(value)).otherwise(F.concat(F.lit('{"input":'), F.to_json(value), F.lit("}")))


def _error(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("error")))


_KEYS = ["conv_id", "pos"]
#: So many keys at most are sent to every task.
FEW = 100_000


def _only(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose columns of ``keys`` stand there. Few keys are sent to the rows, so that contents which nobody asks for are not dealt."""
    asked = held.cut(keys.distinct())
    return rows.join(F.broadcast(asked) if asked.count() <= FEW else asked, asked.columns, "left_semi")


def read_files(calls: DataFrame, files: DataFrame) -> DataFrame:
    """calls(conv_id, pos, repo_id, path, more) with payload: the head of the file, its lines, and whether there is more."""
    named = _only(files.filter("file_path is not null").select("repo_id", F.col("file_path").alias("path"), "content"), calls.select("repo_id", "path"))
    one = named.groupBy("repo_id", "path").agg(F.max_by("content", F.struct("content")).alias("content")).filter("content <> ''")
    lines = F.length("content") - F.length(F.replace("content", F.lit("\n"))) + 1
    payload = F.to_json(F.struct("path", F.substring("content", 1, READ).alias("content"), lines.alias("lines"), (F.length("content") > READ).alias("truncated")))
    found = calls.join(one.select("repo_id", "path", payload.alias("payload")), ["repo_id", "path"], "left")
    return found.select(*calls.columns, F.when(F.col("path") == "", _error(F.lit("path is required"))).otherwise(F.coalesce("payload", _error(F.concat(F.lit("could not read "), "path")))).alias("payload"))


def _matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first HITS lines of each file that match: of one file no more can be among the first HITS of many."""
    known: dict[str, re.Pattern] = {}
    for pdf in batches:
        out = []
        for repo, query, path, content in zip(pdf["repo_id"], pdf["query"], pdf["file_path"], pdf["content"], strict=True):
            if query not in known:
                try:
                    known[query] = re.compile(query, re.I)
                except re.error:
                    known[query] = re.compile(re.escape(query), re.I)
            lines = enumerate((content or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"))
            out += islice(((repo, query, path, k + 1, line.strip()[:200]) for k, line in lines if known[query].search(line)), HITS)
        yield pd.DataFrame(out, columns=["repo_id", "query", "file_path", "line", "text"])


def search_files(calls: DataFrame, files: DataFrame) -> DataFrame:
    """calls(conv_id, pos, repo_id, query, most, more) with payload: the first matching lines of the repository's first files.

    Files are taken by ord, each by its head; a broken pattern is literal text. The first lines by path and place are kept.
    What many calls ask of a repository is searched once, and which files are its first is told by their names alone.
    """
    searches = held.cut(calls.filter("query <> ''").select("repo_id", "query").distinct())
    place = F.row_number().over(Window.partitionBy("repo_id").orderBy(*[c for c in ("ord",) if c in files.columns], "file_path"))
    first = lambda rows: rows.withColumn("_n", place).filter(F.col("_n") <= SEARCHED_FILES)
    here = files.filter("file_path is not null").withColumn("content", F.substring("content", 1, READ))
    names = first(_only(here.drop("content"), searches.select("repo_id"))).select("repo_id", "file_path")
    heads = first(_only(here, names)).select("repo_id", "file_path", "content")
    shape = f"repo_id {dict(calls.dtypes)['repo_id']}, query string, file_path string, line int, text string"
    found = searches.join(heads, "repo_id").select("repo_id", "query", "file_path", "content").mapInPandas(_matches, shape)
    ranked = found.withColumn("_n", F.row_number().over(Window.partitionBy("repo_id", "query").orderBy("file_path", "line"))).filter(F.col("_n") <= HITS)
    rows = ranked.groupBy("repo_id", "query").agg(F.array_sort(F.collect_list(F.struct("file_path", "line", "text"))).alias("matches"))
    none = F.array().cast("array<struct<file_path:string,line:int,text:string>>")
    done = calls.join(rows, ["repo_id", "query"], "left").withColumn("matches", F.slice(F.coalesce("matches", none), F.lit(1), F.col("most")))
    payload = F.to_json(F.struct("query", "matches", (F.size("matches") >= F.col("most")).alias("truncated")))
    return done.select(*calls.columns, F.when(F.col("query") == "", _error(F.lit("query is required"))).otherwise(payload).alias("payload"))


def list_links(calls: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """calls(conv_id, pos, repo_id, path, more) with payload: what the file imports and what imports it; of a file unknown, twenty that are known."""
    keys = calls.select("repo_id", "path")
    down = _only(edges.select("repo_id", F.col("target").alias("path"), "source"), keys).groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("source")).alias("dependents"))
    up = _only(edges.select("repo_id", F.col("source").alias("path"), "target"), keys).groupBy("repo_id", "path").agg(F.array_sort(F.collect_set("target")).alias("dependencies"))
    named = files.filter("file_path is not null").select("repo_id", F.col("file_path").alias("path"))
    here = _only(named, keys).distinct()
    early = _only(named, keys.select("repo_id")).withColumn("_n", F.dense_rank().over(Window.partitionBy("repo_id").orderBy("path"))).filter("_n <= 20")
    first = early.groupBy("repo_id").agg(F.array_sort(F.collect_set("path")).alias("known"))
    none = F.array().cast("array<string>")
    linked = calls.join(down, ["repo_id", "path"], "left").join(up, ["repo_id", "path"], "left").join(here.withColumn("_here", F.lit(True)), ["repo_id", "path"], "left").join(first, "repo_id", "left")
    payload = F.to_json(F.struct("path", F.coalesce("dependencies", none).alias("dependencies"), F.coalesce("dependents", none).alias("dependents")))
    unknown = F.to_json(F.struct(F.concat("path", F.lit(" is not known")).alias("error"), F.coalesce("known", none).alias("known")))
    found = F.col("dependents").isNotNull() | F.col("dependencies").isNotNull() | F.col("_here").isNotNull()
    return linked.select(*calls.columns, F.when(found, payload).otherwise(unknown).alias("payload"))


def execute(calls: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Adds arguments (an object) and payload (JSON) to calls(conv_id, pos, repo_id, name, arguments). None raises: a failure is a payload with an error.

    Only look-ups that are called for read their tables.
    """
    args = held.cut(calls.withColumn("arguments", parsed_arguments(F.col("arguments"))))
    value = lambda name: F.btrim(F.coalesce(F.get_json_object("arguments", f"$.{name}"), F.lit("")))
    most = F.greatest(F.lit(1), F.least(F.lit(HITS), F.coalesce(F.nullif(value("max_results").try_cast("int"), F.lit(0)), F.lit(HITS))))
    path, query = {"path": value("path")}, {"query": value("query"), "most": most}
    kinds = {"read_file": (path, lambda x: read_files(x, files)), "search_code": (query, lambda x: search_files(x, files)), "list_dependencies_of_file": (path, lambda x: list_links(x, files, edges))}
    called = args.agg(*[F.max(F.col("name") == name).alias(name) for name in kinds]).first()
    out = args.filter(~F.coalesce(F.col("name").isin(NAMES), F.lit(False))).withColumn("payload", _error(F.concat(F.lit("unknown tool: "), F.coalesce("name", F.lit("")))))
    for name, (columns, answer) in kinds.items():
        if called[name]:
            out = out.unionByName(answer(args.filter(F.col("name") == name).withColumns(columns)).select(*out.columns))
    return out


def converse(conversations: DataFrame, files: DataFrame, edges: DataFrame, model: Model, rounds: int = 6) -> DataFrame:
    """conv_id, answer, rounds, records, read of conversations(conv_id, repo_id, said: the messages so far).

    The model is asked up to ``rounds`` times with tools, then once more without. records are the calls in order with the
    heads of their results; read the files that were read, each once. A last text that is itself a call is no answer, and
    the answer says so. A conversation without messages is asked all the same; conv_id is unique and not null.
    files(repo_id, file_path, content, ord?) and edges(repo_id, source, target) are what look-ups see.
    """
    open_ = held.cut(conversations.select("conv_id", "repo_id", F.coalesce("said", F.array().cast(SAID)).cast(SAID).alias("said"), F.array().cast(RECORDS).alias("records")))
    closed, number = [], 0
    for number in range(1, max(1, rounds) + 1):
        turned = held.cut(open_.join(model(open_, number, True), "conv_id", "left"))
        goes_on = F.size(F.coalesce("calls", F.array().cast(CALLS))) > 0
        closed.append(turned.filter(~goes_on).select("conv_id", F.coalesce("text", F.lit("")).alias("answer"), F.lit(number).alias("rounds"), "records"))
        calls = turned.filter(goes_on)
        if calls.isEmpty():
            break
        results = execute(calls.select("conv_id", "repo_id", F.posexplode("calls").alias("pos", "call")).select("conv_id", "repo_id", "pos", "call.name", "call.arguments"), files, edges)
        listed = results.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("name", F.lit("")).alias("name"), "arguments", "payload"))).alias("done"))
        new = F.transform("done", lambda x: F.struct(x["name"].alias("name"), x["arguments"].alias("arguments"), F.substring(x["payload"], 1, PREVIEW).alias("result_preview")))
        told = F.transform("done", lambda x: F.struct(F.lit("tool").alias("role"), F.substring(x["payload"], 1, PAYLOAD).alias("content")))
        own = F.array(F.struct(F.lit("assistant").alias("role"), F.coalesce("text", F.lit("")).alias("content")))
        open_ = held.cut(calls.join(listed, "conv_id").select("conv_id", "repo_id", F.concat("said", own, told).cast(SAID).alias("said"), F.concat("records", new).cast(RECORDS).alias("records")))
    else:
        end = F.array(F.struct(F.lit("user").alias("role"), F.lit(WRAP_UP).alias("content")))
        last = open_.withColumn("said", F.concat("said", end).cast(SAID))
        text = F.coalesce("text", F.lit(""))
        answer = F.when(X.is_tool_call_text(text, NAMES), f"All {max(1, rounds)} rounds of look-ups were used without an answer.").otherwise(text)
        closed.append(last.join(model(last, number + 1, False), "conv_id", "left").select("conv_id", answer.alias("answer"), F.lit(number + 1).alias("rounds"), "records"))
    out = closed[0]
    for part in closed[1:]:
        out = out.unionByName(part)
    paths = F.transform(F.filter("records", lambda r: r["name"] == "read_file"), lambda r: F.btrim(F.coalesce(F.get_json_object(r["arguments"], "$.path"), F.lit(""))))
    return out.withColumn("read", F.array_distinct(F.filter(paths, lambda p: p != "")))
