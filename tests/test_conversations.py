"""Conversations as tables against the loop that holds one at a time."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import conversations, tools

FILES = [("r", "a.py", "import b\nx = 1\n" + "y = 2\n" * 3000, 0), ("r", "b.py", "def f():\n    return 'Token(1'\n", 1), ("r", "e.py", "", 2), ("s", "a.py", "other\ntoken\n", 0), ("s", None, "x", 1)]
EDGES = [("r", "a.py", "b.py")]
SCRIPT = {
    1: [("", [("read_file", '{"path": "a.py"}'), ("read_file", '{"path": " "}'), ("read_file", '{"path": "no.py"}')]), ("", [("search_code", '{"query": "token(", "max_results": 3}'), ("nothing", "{}")]), ("Done.", [])],
    2: [("At once.", [])],
    3: [("", [("list_dependencies_of_file", '{"path": "b.py"}'), ("read_file", "not json"), ("read_file", '["x"]')])] * 2 + [("", [("list_dependencies_of_file", '{"path": "zz"}')])] * 4 + [('read_file({"path": "a.py"})', [])],
    4: [("", [("search_code", '{"query": "TOKEN", "max_results": "x"}'), ("read_file", '{"path": "e.py"}'), ("read_file", '{"path": "a.py"}'), ("search_code", "{}")]), ("So.", [])],
    5: [("", [("read_file", "{}")])] * 6 + [("Out of rounds.", [])],
}


@pytest.fixture(scope="module")
def given(spark):
    convs = [(c, "s" if c == 4 else "r", [("user", f"question {c}")]) for c in SCRIPT] + [(6, "gone", None)]
    return (
        spark.createDataFrame(convs, f"conv_id long, repo_id string, said {conversations.SAID}"), spark.createDataFrame(FILES, "repo_id string, file_path string, content string, ord int"), spark.createDataFrame(EDGES, "repo_id string, source string, target string"),
    )


def plain(spark, c, repo):
    here = spark.createDataFrame([f[1:] for f in FILES if f[0] == repo and f[1]], "file_path string, content string, ord int")
    links = spark.createDataFrame([e[1:] for e in EDGES if e[0] == repo], "source string, target string")
    turns = iter(SCRIPT[c])
    return tools.loop([], lambda said, allowed: tools.Turn(*next(turns)), tools.Tools(here, links).execute)


def loose(record):
    """A record as both forms have it: metrics are the driver form's own, and previews are cut JSON."""
    return record["name"], record["arguments"], record["result_preview"].replace('": ', '":').replace(', "', ',"')[:60]


def test_against_the_loop(spark, given):
    turns = [(c, k + 1, text, [{"name": n, "arguments": a} for n, a in calls]) for c, script in SCRIPT.items() for k, (text, calls) in enumerate(script)]
    model = conversations.scripted(spark.createDataFrame(turns, f"conv_id long, round int, text string, calls {conversations.CALLS}"))
    out = {r.conv_id: r for r in conversations.converse(*given, model).collect()}
    assert sorted(out) == [1, 2, 3, 4, 5, 6] and out[6].answer == "" and out[6].records == []
    for c in SCRIPT:
        answer, records = plain(spark, c, "s" if c == 4 else "r")
        assert out[c].answer == answer
        got = [{"name": r.name, "arguments": json.loads(r.arguments), "result_preview": r.result_preview} for r in out[c].records]
        assert [loose(r) for r in got] == [loose(r) for r in records], c
    assert {c: r.rounds for c, r in out.items()} == {1: 3, 2: 1, 3: 7, 4: 2, 5: 7, 6: 1} and out[1].read == ["a.py", "no.py"] and out[3].answer.startswith("All 6 rounds")
    assert all(len(x.result_preview) <= 400 for r in out.values() for x in r.records)


def test_model_as_a_function(spark, given):
    def model(said, allowed):
        if said and said[0]["content"] == "question 2":
            raise ValueError
        if allowed and sum(m["role"] == "tool" for m in said) < 2:
            return tools.Turn("", [("read_file", '{"path": "b.py"}')])
        return tools.Turn(f"{len(said)} messages, {said[-1]['role']}")

    out = {r.conv_id: r for r in conversations.converse(*given, conversations.asked(model), rounds=2).collect()}
    assert out[1].answer == "6 messages, user" and len(out[1].records) == 2 and out[2].answer == "" and out[1].read == ["b.py"]
    assert json.loads(out[1].records[0].result_preview)["lines"] == 3 and "could not read" in out[4].records[0].result_preview


def test_no_conversations(spark, given):
    convs, files, edges = given
    none = conversations.scripted(spark.createDataFrame([], f"conv_id long, round int, text string, calls {conversations.CALLS}"))
    assert conversations.converse(convs.filter(F.lit(False)), files, edges, none).count() == 0


def dealt_bytes(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    known = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(known.apply(k).totalShuffleWrite() for k in range(known.size()))


def test_contents_that_nobody_asks_for_are_not_dealt(spark):
    """Ninety calls for one file and one search: other contents stay where they are, and each call has the first lines it asked for."""
    rng = random.Random(2)
    files = [("r", f"f{k:04d}.py", "Token a\n" * 40 if k == 1 else "token b\r\n token c" if k == 0 else rng.randbytes(10_000).hex(), 600 - k if k > 1 else k) for k in range(600)]
    files += [("s", "g.py", "token d", 0)]
    files = spark.createDataFrame(files, "repo_id string, file_path string, content string, ord int")
    edges = spark.createDataFrame(EDGES, "repo_id string, source string, target string")
    calls = [(c, 0, "r", "search_code", json.dumps({"query": "TOKEN", "max_results": c % 40})) for c in range(60)] + [(c, 1, "r", "read_file", '{"path": "f0000.py"}') for c in range(30)]
    calls = spark.createDataFrame(calls, "conv_id long, pos int, repo_id string, name string, arguments string")
    before = dealt_bytes(spark)
    out = {(r.conv_id, r.pos): json.loads(r.payload) for r in conversations.execute(calls, files, edges).collect()}
    assert dealt_bytes(spark) - before < 5_000_000  # the heads of 400 files are searched, 3.2 MB
    lines = [("f0000.py", 1, "token b"), ("f0000.py", 2, "token c")] + [("f0001.py", k + 1, "Token a") for k in range(40)]
    for c in range(60):
        most = min(c % 40, 25) or 25
        assert [(m["file_path"], m["line"], m["text"]) for m in out[c, 0]["matches"]] == lines[:most] and out[c, 0]["truncated"]
    assert len(out) == 90 and out[3, 1] == {"path": "f0000.py", "content": "token b\r\n token c", "lines": 2, "truncated": False}
