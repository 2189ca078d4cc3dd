"""Passes that ask others, look-ups, context, streams and stores: small cases, plain versions, and what must never raise."""

import datetime
import json
import subprocess

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import exprs as X
from corpusmill.operators import context, findings, patches, review, scan, search, summaries, tools
from corpusmill.plans.catalog import QUERIES
from corpusmill.plans.passes import tree
from corpusmill.sources import files, git, prompts, snapshots
from corpusmill.streaming import events, limits, progress


def test_scan_feeds_what_follows(spark):
    """Findings of a scan go through order, batches, verdicts, fixes, merging and lookup as they come."""
    rows = [("r1", "a.py", "x = 1\neval(a)\n\tpassword = 'abcdefgh123456'\n"), ("r1", "b.py", "\t# eval(x)\n\t# token = 'abcdefgh123456'\n"), ("r2", "a.py", "eval(b)"), ("r2", "m.json", "eval(c)")]
    texts = spark.createDataFrame(rows, "repo_id string, file_path string, content string").withColumn("is_manifest", F.col("file_path") == "m.json")
    found = findings.with_place(scan.findings(texts), ["repo_id"])
    seen = {(r.repo_id, r.id, r.confidence, r.name) for r in found.collect()}
    assert {s[:2] for s in seen} == {("r1", "code_execution:a.py:2"), ("r1", "hardcoded_secret:a.py:3"), ("r1", "code_execution:b.py:1"), ("r2", "code_execution:a.py:1")}
    assert {s[2] for s in seen} == {"medium"} and all(s[3] for s in seen)
    said = {"verdicts": [{"id": "code_execution:a.py:2", "verdict": "downgrade", "severity": "low", "explanation": "e"}], "additional_findings": [{"file_path": "a.py", "line": "2", "description": "d", "severity": "critical", "name": "Worse"}]}
    answers = spark.createDataFrame([("triage/r1/0", "```json\n" + json.dumps(said) + "\n```")], "request_id string, answer string")
    judged, extra, lost = review.triage(found, texts, answers, ["repo_id"])
    by = {(r.repo_id, r.id): (r.triage, r.severity, r.original_severity) for r in judged.collect()}
    assert by[("r1", "code_execution:a.py:2")] == ("downgraded", "LOW", "HIGH") and by[("r2", "code_execution:a.py:1")] == ("pending", "HIGH", None)
    assert [r.batch_id for r in lost.collect()] == ["r2/0"]
    both = findings.dedupe(findings.with_model(judged.drop("gap", "original_severity", "ord", "batch_id"), extra))
    here = [r for r in both.collect() if (r.repo_id, r.file_path, r.line) == ("r1", "a.py", 2)]
    assert [(r.name, r.severity, r.source) for r in here] == [("Worse", "CRITICAL", "static-analysis")]
    assert findings.dedupe(found.limit(0)).count() == 0


def test_prompts_hold_the_lines_around(spark):
    f = spark.createDataFrame([("r", "a", "ru", "pattern", "HIGH", "f", 2, "d", "s", "n", "rec", None, 1)], "repo_id string, id string, rule string, detector string, severity string, file_path string, line long, description string, snippet string, name string, recommendation string, triage string, ord int")
    text = spark.createDataFrame([("r", "f", "one\r\ntwo\r\nthree\n")], "repo_id string, file_path string, content string")
    payload = json.loads(review.candidates(f, text).first().payload)
    assert payload["surrounding_code"] == "1: one\n2: two\n3: three" and payload["reported_severity"] == "HIGH"
    asked = review.requests(review.candidates(f, text), ["repo_id"], "Judge.", "triage").first()
    assert asked.request_id == "triage/r/0" and json.loads(asked.prompt.removeprefix("Judge.\n"))[0]["id"] == "a"


def test_providers(spark):
    waits, tries = [], []

    def shaky(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise review.Unavailable("busy", after=100.0 if len(tries) == 1 else None)
        return "yes"

    assert review.call(shaky, "p", 3, waits.append) == ("yes", 3, "") and waits[0] == 30.0 and 0 <= waits[1] <= 1.5
    assert review.call(shaky, "p", 1, waits.append)[0] == "yes"
    assert review.call(lambda p: 1 / 0, "p")[0] is None
    assert all(review.wait_before(k) <= 8 for k in range(20))
    rows = spark.createDataFrame([("a", "1"), ("b", "x")], "request_id string, prompt string")
    got = {r.request_id: (r.answer, r.error != "") for r in review.ask(rows, lambda p: str(int(p) + 1)).collect()}
    assert got == {"a": ("2", False), "b": (None, True)}
    table = spark.createDataFrame([("a", "said")], "request_id string, answer string")
    assert {r.request_id: r.answer for r in review.ask(rows, table).collect()} == {"a": "said", "b": None}


def test_look_ups_and_the_loop(spark):
    t = tools.Tools(spark.createDataFrame([("a.py", "import b\nTOKEN\n", 3, 0), ("b.py", "token(", 1, 1)], "file_path string, content string, complexity int, ord int"), spark.createDataFrame([("a.py", "b.py")], "source string, target string"))
    assert t.execute("read_file", {"path": "a.py"})["lines"] == 3 and "error" in t.execute("read_file", {"path": "../x"}) and "error" in t.execute("read_file", {})
    assert [m["file_path"] for m in t.execute("search_code", {"query": "token("})["matches"]] == ["b.py"] and t.execute("search_code", {"query": "token", "max_results": "1"})["truncated"]
    assert t.execute("list_dependencies_of_file", {"path": "b.py"})["dependents"] == ["a.py"] and t.execute("list_dependencies_of_file", {"path": "zz"})["known"] == ["a.py", "b.py"]
    assert "error" in t.execute("drop_table", {})
    turns = iter([tools.Turn("", [("read_file", '{"path": "a.py"}'), ("read_file", "broken"), ("search_code", "[1]")]), tools.Turn("it imports b")])
    out = tools.chat("what?", "context", t, lambda said, allowed: next(turns))
    assert out["answer"] == "it imports b" and out["read"] == ["a.py"] and [r["name"] for r in out["records"]] == ["read_file", "read_file", "search_code"] and out["records"][2]["arguments"] == {"input": [1]}
    asked = []

    def stubborn(said, allowed):
        asked.append(allowed)
        return tools.Turn("<tool_call>read", [("read_file", "{}")] if allowed else [])

    text, records = tools.loop([], stubborn, lambda n, a: 1 / 0, 2)
    assert asked == [True, True, False] and "without an answer" in text and "division" in records[0]["result_preview"]


def test_json_answers():
    said = iter([ValueError("no schema"), "no json", 'here: [{"a": 1,}] {"b": 2}'])

    def model(prompt, strict):
        x = next(said)
        if isinstance(x, Exception):
            raise x
        return x

    assert tools.json_answer(model, "p") == ([{"a": 1}], 3)
    with pytest.raises(ValueError, match="no JSON"):
        tools.json_answer(lambda p, s: "nothing", "p", 2)


def test_json_recovery_like_plain(spark):
    raws = ['{"a": "}"}', "x {\"a\": '}'} y", '[{"a": 1}, {"a": 2}] tail', 'a {"b": [1, {"c": "]"}]} z', '```js\n{"n": None}\n```', "{'a': 1}", '{"u": "a//b"}', "", "   ", "[1, 2", '{"a": "\\"}"} {', "“x”", "null"]
    got = [r.j for r in spark.createDataFrame(list(enumerate(raws)), "i int, t string").select("i", F.to_json(X.extract_json(F.col("t"))).alias("j")).orderBy("i").collect()]
    assert [None if j is None or j == "null" else json.loads(j) for j in got] == [tools.recover(t) for t in raws]


def plain_gather(chosen, texts, links, order):
    """The walk of a context, one target after the other."""
    used, out, total = [], [], 0
    for path in chosen[:12]:
        if path in used:
            continue
        used.append(path)
        cut = texts[path][:12_000][:6000]
        out.append(("target", path, len(cut)))
        total += len(cut)
        folder = path.rpartition("/")[0]
        near = sorted(o for o in links.get(path, set()) if o != path) + [p for p in order if p != path and p.rpartition("/")[0] == folder]
        added = 0
        for p in near:
            if added >= 2 or total >= 32_000:
                break
            if p in used or not texts[p]:
                continue
            used.append(p)
            out.append(("related", p, len(texts[p][:4000])))
            total, added = total + len(texts[p][:4000]), added + 1
        if total >= 32_000:
            break
    return out


def test_gathered_context(spark, medium):
    pdf = tree(spark, medium).toPandas().sort_values("ord")
    got = QUERIES["gathered_context"](spark, medium).toPandas().sort_values(["repo_id", "place"])
    for repo, rows in pdf.groupby("repo_id"):
        first = rows.drop_duplicates("file_path")
        ords, texts = dict(zip(first.file_path, first.ord)), dict(zip(first.file_path, first.content))
        links = {}
        for a, x in ords.items():
            for b, y in ords.items():
                if y == x + 9:
                    links.setdefault(a, set()).add(b), links.setdefault(b, set()).add(a)
        files_ = spark.createDataFrame(first[["repo_id", "file_path", "ord", "content"]])
        chosen = [r.file_path for r in context.select(files_, "give me an overview of login", ["repo_id"]).orderBy("place").collect()]
        want = plain_gather(chosen, texts, links, list(first.file_path))
        assert [tuple(r) for r in got[got.repo_id == repo][["role", "file_path", "chars"]].itertuples(index=False)] == want


def test_broad_selection_takes_structural_files(spark):
    rows = spark.createDataFrame([("r", "a/login.py", 0), ("r", "b/x.py", 1), ("r", "b/x.py", 2), ("s", "q.py", 0)], "repo_id string, file_path string, ord int")
    named = spark.createDataFrame([("r", "b/x.py")], "repo_id string, file_path string")
    got = [(r.repo_id, r.file_path) for r in context.select(rows, "overview of login", ["repo_id"], named).orderBy("repo_id", "place").collect()]
    assert got == [("r", "a/login.py"), ("r", "b/x.py"), ("s", "q.py")]
    assert context.is_broad("How does it work") and not context.is_broad("read src/a.py")


def test_runs_are_joined_or_refused(spark, medium):
    assert limits.decide([(0, "a", 10), (1, "a", 10), (2, "b", 10), (3, "c", 10), (4, "d", 10), (5, "e", 10), (20, "e", 1), (250, "a", 1), (301, "a", 1)]) == [("started", 0), ("attached", 0), ("started", 2), ("started", 3), ("started", 4), ("rejected", None), ("started", 20), ("attached", 0), ("started", 301)]
    e = spark.read.parquet(f"{medium}/events.parquet").toPandas()
    got = QUERIES["admitted_runs"](spark, medium).toPandas().set_index("event_id").decision
    for _, rows in e.groupby("event_type"):
        rows = rows.assign(at=rows.ts.astype("datetime64[us]").astype("int64") / 1e6).sort_values(["at", "event_id"])
        want = limits.decide([(a, str(u % 12), (u % 7 + 1) * 9000.0) for a, u in zip(rows["at"], rows.user_id)])
        assert got.loc[rows.event_id].tolist() == [d for d, _ in want]
    assert len(set(got)) == 3


def test_a_key_in_several_frames_is_judged_in_order(spark):
    rows = [("k", float(t), t) for t in range(3000)] + [("j", 0.0, 9000)]
    df = spark.createDataFrame(rows[::-1], "key string, at double, event_id long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r.event_id: r.allowed for r in limits.limit(df, 2, 100).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    tokens, updated, want = None, 0.0, {9000: True}
    for _, at, event in rows[:-1]:
        tokens, want[event], _ = limits.take(tokens, updated, at, 2, 100)
        updated = max(updated, at)
    assert got == want


def test_streams_and_listeners(spark, tmp_path):
    opened = []

    def stream(fails_at):
        def run():
            opened.append(1)
            for k in range(3):
                if len(opened) == 1 and k == fails_at:
                    raise OSError("cut")
                yield str(k)

        return run

    assert list(events.restarted(stream(0))) == ["0", "1", "2"] and len(opened) == 2
    opened.clear()
    with pytest.raises(OSError):
        list(events.restarted(stream(1)))
    assert len(opened) == 1
    heard = []
    report = progress.reporter(lambda m: heard.append(m) or 1 / 0)
    report("begun")
    assert heard == ["begun"]
    spark.createDataFrame([("s", 0, "delta", "a\nb")], "stream_id string, place int, event string, data string").write.parquet(str(tmp_path / "in"))
    got = []
    source = spark.readStream.schema("stream_id string, place int, event string, data string").parquet(str(tmp_path / "in"))
    events.sink(source, lambda df, n: got.extend(r.frame for r in df.collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert got == ["event: delta\ndata: a\ndata: b\n\n"]
    (tmp_path / "p.txt").write_text(" hello \n")
    assert prompts.load(str(tmp_path), "p.txt") == "hello"
    with pytest.raises(ValueError):
        prompts.load(str(tmp_path), "../p.txt")


def test_git(spark, tmp_path):
    repo = tmp_path / "a+b"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "pkg").mkdir()
    for k in range(3):
        (repo / "pkg" / "x.py").write_text("v\n" * (k + 1))
        run("add", ".")
        run("commit", "-qm", f"c{k}")
    assert git.head(str(repo)) == git.remote_head(str(repo)) and git.commit_count(str(repo)) == 3 and not git.is_shallow(str(repo))
    from corpusmill.operators import churn

    rows = churn.churn(churn.parse_log(git.logs(spark, {"r": str(repo)})), ["repo_id", "path"]).collect()
    assert [(r.path, r.commits, r.authors) for r in rows] == [("pkg/x.py", 3, 1)]
    lines = churn.parse_numstat(git.logs(spark, {"r": str(repo)}, lines=True)).agg(F.sum("added")).first()[0]
    assert lines == 3
    copy = git.clone("file://" + str(repo), str(tmp_path / "copy"))
    assert git.is_shallow(copy) and git.deepen(copy, 1) and git.commit_count(copy) == 2
    assert git.clone("file://" + str(repo), str(tmp_path / "small"), most_bytes=10) == "" and not (tmp_path / "small").exists()
    assert git.clone(str(tmp_path / "none"), str(tmp_path / "z")) == "" and git.remote_head(str(tmp_path)) == ""
    assert [(r.file_path, r.language) for r in files.scan(spark, str(repo)).collect()] == [("pkg/x.py", "python")]
    assert {(r.repo_id, r.file_path) for r in files.scan_all(spark, {"p": str(repo), "q": copy}).collect()} == {("p", "pkg/x.py"), ("q", "pkg/x.py")}
    assert [r.file_path for r in context.listing(files.listing(spark, str(repo))).collect()] == ["pkg/x.py"]


def test_stores(spark, tmp_path):
    now = datetime.datetime(2024, 1, 3)
    old = spark.createDataFrame([("a", "u", now - datetime.timedelta(hours=30)), ("b", "v", now - datetime.timedelta(hours=1))], "repo_id string, repo_url string, modified timestamp")
    new = spark.createDataFrame([("a", "u", now)], old.schema)
    assert {r.repo_id for r in snapshots.register(old, new, now).collect()} == {"a", "b"}
    assert {r.repo_id for r in snapshots.register(old, new.limit(0), now).collect()} == {"b"}
    (tmp_path / "c.json").write_text(json.dumps([{"slug": "one", "snapshot": "1.json", "repo_url": "u", "label": None}, {"slug": "two", "snapshot": ""}]))
    shots = spark.createDataFrame([("1.json", "/secret", "x")], "snapshot string, repo_path string, head_sha string")
    entries = snapshots.catalogue(spark, str(tmp_path / "c.json"))
    (r,) = snapshots.demo(entries, shots, "one").collect()
    assert r.repo_path == "" and r.demo.label == "one" and entries.count() == 1 and snapshots.demo(entries, shots, "../one").count() == 0
    snapshots.export(shots, str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0])["head_sha"] == "x"
    public = snapshots.public(spark.createDataFrame([("i", None)], "repo_id string, stats string")).first()
    assert len(public) == 18 and public.stats == "{}" and public.truncated is False


def test_summaries_of_nothing(spark):
    none = spark.createDataFrame([], "repo string, language string, ord int, severity string, triage string, x double")
    assert summaries.legend(none, ["repo"]).count() == summaries.live_severities(none, ["repo"]).count() == summaries.median(none, ["repo"], "x").count() == 0
    assert summaries.jobs(spark.createDataFrame([], "finished_at long, error string")).first().running == 0
    assert search.read_file(spark.createDataFrame([("a", "x")], "file_path string, content string"), "b").count() == 0


def test_diffs_that_change_nothing_or_repeat():
    source = "a\nb\nc"
    once = patches.reanchor(source, patches.clean("--- a/f\n+++ b/f\n@@ -1 +1 @@\n-b\n+B\n"), "f")
    assert patches.clean(once) == once and patches.apply(source, once, strict=True)[0] == "a\nB\nc"
    assert patches.reanchor(source, patches.clean("--- a/f\n+++ b/f\n@@ -1 +1 @@\n b\n"), "f") == "" and patches.clean("this text is no diff") == ""


def test_changes_stand_where_their_removed_lines_do():
    """Context that is not the file's is not asked for; long blocks come first; what cannot be placed is left alone."""
    place = lambda source, diff: patches.apply(source, patches.reanchor(source, patches.clean(diff), "app.py"), strict=True)[0]
    source = "import os\n\n\ndef f():\n    return 1\n\n\nclass A:\n    pass\n"
    diff = "--- a/app.py\n+++ b/app.py\n@@ -1,11 +1,11 @@\n import os\n def f():\n-    return 1\n+    return 2\n class A:\n"
    assert place(source, diff) == source.replace("return 1", "return 2")
    once = patches.reanchor(source, patches.clean(diff), "app.py")
    assert once.split("\n").count(" ") == 4 and patches.reanchor(source, once, "app.py") == once
    two = "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n gone\n-x\n+X\n@@ -9,9 +9,9 @@\n gone too\n-x\n-y\n-z\n+long\n"
    assert place("a\nx\ny\nz\nb\nx\nc", two) == "a\nlong\nb\nX\nc"  # the short block would take a line of the long one
    assert patches.reanchor("keep\nsomething else\n", patches.clean("--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n keep\n-never in the file\n+x\n"), "f") == ""
    repeated = "a\nx\nb\nx\nc\nx\nd"
    assert place(repeated, "--- a/f\n+++ b/f\n@@ -5,3 +5,3 @@\n c\n-x\n+X\n d\n") == "a\nx\nb\nx\nc\nX\nd"  # right context says which
    apart = "--- a/f\n+++ b/f\n@@ -1,5 +1,5 @@\n-one\n+ONE\n wrong\n-three\n+THREE\n+3b\n"
    assert place("one\ntwo\nthree", apart) == "ONE\ntwo\nTHREE\n3b" and place("one\none\ntwo\nthree", apart) is None
    assert place("a\nb", "--- a/f\n+++ b/f\n@@ -1,2 +1,3 @@\n a\n+new\n b\n") == "a\nnew\nb" and place("a\nb\nc", "--- a/f\n+++ b/f\n@@ -7 +7 @@\n no\n-b\n") == "a\nc"


def test_architectures():
    empty = review.clean({"note": 1})
    assert not empty["extracted"] and empty["layers"] == [] and review.clean([1])["summary"] == ""
    many = review.clean({"analysis": {"overview": "o" * 3000, "modules": [{"name": "a", "files": ["x"]}, " b ", {}, 3], "risk": [{"location": "p", "risk": "r", "file_path": "q"}]}})
    assert many["extracted"] and len(many["summary"]) == 2000 and [x["name"] for x in many["layers"]] == ["a", "b"] and many["risks"] == [{"file_path": "p", "risk": "r"}]


def test_holding_back():
    assert events.hold_back("plain text") == ("plain text", "") and events.hold_back("a <tool") == ("a ", "<tool")
    assert events.hold_back("to recipient: x\nmore") == ("to recipient: x", "\nmore") and events.hold_back("Recipient: x\nmore") == ("Recipient: x\nmore", "") and events.hold_back("a recipient") == ("a recipien", "t")
    assert events.hold_back("<" + "x" * 60) == ("<" + "x" * 60, "") and "".join(d for e, d in events.fold(list("a recipient <b")) if e == "delta") == "a recipient <b"


def test_proposals(spark):
    """A diff that does not apply is asked for again with the reason; what cannot be mended says why."""
    text = "\n".join(f"line {k}" for k in range(1, 9))
    found = spark.createDataFrame([("ok", "f", 3), ("again", "f", 4), ("never", "f", 5), ("prose", "f", 6), ("evil", "f", 6), ("far", "f", 0), ("gone", "g", 1)], "id string, file_path string, line long").withColumns({c: F.col("id") for c in ("name", "severity", "description", "snippet", "recommendation")})

    def provider(prompt):
        asked = json.loads(prompt.split("\n\n")[1])["name"]
        good = "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n-line 3\n+LINE 3\n"
        diffs = {"ok": good, "again": good if "did not apply" in prompt else good.replace("line 3", "absent"), "never": good.replace("line 3", "absent"), "prose": "", "evil": good.replace("b/f", "b/../f")}
        return json.dumps({"diff": diffs[asked], "explanation": "so", "risk": " LOW"})

    out = {r.id: r for r in review.propose(found, spark.createDataFrame([("f", text)], "file_path string, content string"), provider).collect()}
    assert {k: (r.applies, r.attempts) for k, r in out.items()} == {"ok": (True, 1), "again": (True, 2), "never": (False, 2), "prose": (False, 1), "evil": (False, 1), "far": (False, 0), "gone": (False, 0)}
    assert patches.apply(text, out["again"].diff, strict=True)[0] == text.replace("line 3", "LINE 3") and out["ok"].risk == "low" and "not readable" in out["gone"].validation


def test_files_on_disk_that_are_not_known(spark):
    files_ = spark.createDataFrame([("r", "a.py", "python", 3)], "repo_id string, file_path string, language string, complexity int")
    disk = spark.createDataFrame([("r", "a.py", 1), ("r", "b.md", 1), ("s", "a.py", 1), ("r", "x.bin", 1)], "repo_id string, file_path string, length long")
    assert {tuple(r) for r in context.with_disk(files_, disk).collect()} == {("r", "a.py", "python", 3), ("r", "b.md", "markdown", 0), ("s", "a.py", "python", 0)}


def test_logs_come_in_pieces(spark, small, monkeypatch):
    """No row of a log grows with its repository, and the pieces hold every commit once."""
    from corpusmill.plans import code

    monkeypatch.setattr(code, "LOG_COMMITS", 100)
    logs = code.commit_logs(spark, small).collect()
    assert max(r.log.count("\x01") for r in logs) <= 100 < len(logs)
    shas = [x.split("\x02")[0] for r in logs for x in r.log.split("\x01")[1:]]
    assert len(shas) == len(set(shas)) == spark.read.parquet(f"{small}/lineitem.parquet").join(spark.read.parquet(f"{small}/orders.parquet"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey").distinct().count()
