"""Keyed streams against their batch forms: chunks cut anywhere, micro-batches in any order, restarts between them, ends that are sure to come."""

import random
import time
import tracemalloc

import pandas as pd
import pytest

from corpusmill.plans.catalog import QUERIES
from corpusmill.streaming import events, keyed, limits

TEXT = "event: a\r\ndata: one\r\ndata:two\n\n: note\nid: 7\rdata: x\r\revent: b\n\ndata: é\r\n\r\ndata\n\ndata: open"
CHUNKS = "stream_id string, seq long, piece string, last boolean"


def plain(chunks):
    parser = events.Parser()
    return [e for c in chunks for e in parser.push(c)] + parser.push("", end=True)


def test_parser_at_every_cut():
    whole = plain([TEXT])
    assert [e[:2] for e in whole] == [("a", "one\ntwo"), ("message", "x"), ("message", "é"), ("message", ""), ("message", "open")]
    for a in range(len(TEXT) + 1):
        for b in range(a, len(TEXT) + 1, 3):
            assert plain([TEXT[:a], "", TEXT[a:b], TEXT[b:]]) == whole


def test_parser_is_linear():
    began = time.time()
    assert len(plain(["data: x\n\n" * 200_000])) == 200_000 and len(plain(["data: "] + ["y" * 10] * 300_000)) == 1
    assert time.time() - began < 6


def test_stream_of_chunks_cut_everywhere(spark):
    """Streams cut at every offset, dealt to three micro-batches at random, some pieces twice; the query starts anew for each."""
    rng, rows = random.Random(3), []
    for cut in range(1, len(TEXT)):
        pieces = [TEXT[:cut], TEXT[cut : cut + 1], TEXT[cut + 1 :]]
        rows += [(str(cut), k, p, k == 2) for k, p in enumerate(pieces)]
    batches = [[], [], []]
    for r in rows:
        for b in {rng.randrange(3), rng.randrange(3)}:
            batches[b].append(r)
    out = keyed.replayed([spark.createDataFrame(b, CHUNKS) for b in batches], keyed.parsed, "test").collect()
    want = plain([TEXT])
    for cut in range(1, len(TEXT)):
        assert [(r.event, r.data, r.id) for r in sorted((r for r in out if r.stream_id == str(cut)), key=lambda r: r.place)] == want, cut


def test_answers_end_once(spark):
    """Sources, pieces out of order, a break, an empty answer, pieces after the end, and one that falls silent."""
    first = [("ok", 2, "lo <to", False), ("ok", 0, '["f"]', False), ("broken", 0, "[]", False), ("empty", 0, "[]", True), ("silent", 0, "[]", False), ("silent", 1, "some", False)]
    later = [("ok", 1, "Hel", False), ("ok", 3, "p", True), ("broken", 1, "a", False), ("broken", 2, None, False), ("broken", 3, "late", True), ("ok", 4, "late", True)]
    out = keyed.replayed([spark.createDataFrame(b, CHUNKS) for b in (first, later)], keyed.answered, "test").collect()
    got = {s: [(r.event, r.data) for r in sorted((r for r in out if r.stream_id == s), key=lambda r: r.place)] for s in ("ok", "broken", "empty", "silent")}
    assert got["ok"] == [("sources", '["f"]'), *events.fold(["Hel", "lo <to", "p"])] and got["broken"] == [("sources", "[]"), ("delta", "a"), ("error", "broken"), ("done", "false")]
    assert got["empty"] == [("sources", "[]"), ("error", "empty"), ("done", "false")] and got["silent"] == [("sources", "[]"), ("delta", "some")]


def test_silent_answers_end(spark, tmp_path):
    """With a bound on silence an answer that says no more ends as broken, by a timer."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", keyed.ROCKS)
    spark.createDataFrame([("silent", 0, "[]", False), ("silent", 1, "some", False), ("ok", 0, "[]", False), ("ok", 1, "all", True)], CHUNKS).write.parquet(str(tmp_path / "in"))
    made = keyed.answered(spark.readStream.schema(CHUNKS).parquet(str(tmp_path / "in")), idle_ms=100)
    query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until:
            out = spark.read.schema(made.schema).parquet(str(tmp_path / "out")).collect() if (tmp_path / "out" / "_spark_metadata").exists() else []
            if sum(r.event == "done" for r in out) == 2:
                break
            time.sleep(1)
    finally:
        query.stop()
    got = {s: [(r.event, r.data) for r in sorted((r for r in out if r.stream_id == s), key=lambda r: r.place)] for s in ("ok", "silent")}
    assert got == {"ok": [("sources", "[]"), ("delta", "all"), ("done", "true")], "silent": [("sources", "[]"), ("delta", "some"), ("error", "broken"), ("done", "false")]}


def test_runs_as_a_stream(spark, small):
    rows = spark.read.parquet(f"{small}/events.parquet").collect()
    want = {}
    for kind in {r.event_type for r in rows}:
        own = sorted(((r.ts.timestamp(), r.event_id, str(r.user_id % 12), (r.user_id % 7 + 1) * 9000.0) for r in rows if r.event_type == kind))
        want |= {e: d for (_, e, _, _), d in zip(own, limits.decide([(at, u, s) for at, _, u, s in own]), strict=True)}
    assert {r.event_id: (r.decision, r.started_at) for r in QUERIES["admitted_runs"](spark, small).collect()} == want
    out = QUERIES["streamed_runs"](spark, small).collect()
    assert len(out) == len(want) and {r.event_id: (r.decision, r.started_at) for r in out} == want and len({d for d, _ in want.values()}) == 3


def test_late_subscribers_get_the_log_once(spark):
    shape = "job string, seq long, message string, subscriber string"
    batches = [
        [("j", 1, "a", None), ("j", 2, "b", None), ("k", 1, "x", None)], [("j", None, None, "s"), ("j", 3, "c", None)], [("j", 4, "d", None), ("j", None, None, "t"), ("j", None, None, "s"), ("k", None, None, "s")], [("j", 5, "e", None)],
    ]
    out = keyed.replayed([spark.createDataFrame(b, shape) for b in batches], keyed.subscriptions, "test").collect()
    heard = lambda job, who: [(r.seq, r.replayed) for r in sorted((r for r in out if (r.job, r.subscriber) == (job, who)), key=lambda r: r.seq)]
    assert heard("j", "s") == [(1, True), (2, True), (3, False), (4, False), (5, False)] and heard("j", "t") == [(1, True), (2, True), (3, True), (4, False), (5, False)] and heard("k", "s") == [(1, True)]


@pytest.mark.parametrize("rows", [[], [(None, 0, "data: x\n\n"), ("s", 1, None), ("s", 0, "data: y\n\n"), ("s", 2, "data: z")]])
def test_batch_of_odd_chunks(spark, rows):
    out = events.parse(spark.createDataFrame(rows, "stream_id string, seq int, chunk string")).collect()
    assert [(r.stream_id, r.place, r.data) for r in out] == ([("s", 0, "y"), ("s", 1, "z")] if rows else [])


def test_offsets_of_one_long_log(spark):
    """One job's log over many ranges, with equal instants, messages without seq, and subscribers before, among and after them, in time that does not grow with its square."""
    n, began = 150_000, time.time()
    at = lambda i: i // 3  # noqa: E731  three messages an instant
    messages = spark.range(n).selectExpr("cast(1 as bigint) as job", "if(id % 7 = 0, null, id) as seq", "cast(id div 3 as bigint) as at")
    who = [(k, 1, t) for k, t in enumerate([-1, 0, 1, 777, n // 6, n // 3 - 1, n // 3, n])] + [(99, 1, None)]
    out = events.offsets(messages, spark.createDataFrame([*who, (100, 2, 5)], "subscriber long, job long, at long")).collect()
    said = [i for i in range(n) if i % 7]
    want = {(100, 2): (0, 0, None)}
    for k, job, t in who:
        later = [i for i in said if t is None or at(i) >= t]
        want[k, job] = (len(said) - len(later), len(later), later[0] if later else None)
    assert {(r.subscriber, r.job): (r.n_replayed, r.n_followed, r.first_followed) for r in out} == want
    assert time.time() - began < 90


class Store:
    """A handle whose states are kept here, and whose calls are counted."""

    def __init__(self):
        self.calls, self.values, self.maps, self.timers = 0, {}, {}, []

    def _state(self, kept, **calls):
        def counted(f):
            def call(*a):
                self.calls += 1
                return f(*a)

            return call

        return type("State", (), {name: staticmethod(counted(f)) for name, f in calls.items()})

    def getValueState(self, name, shape, *ttl):  # noqa: N802
        v = self.values
        return self._state(v, exists=lambda: name in v, get=lambda: v.get(name), update=lambda x: v.__setitem__(name, x))

    def getListState(self, name, shape, *ttl):  # noqa: N802
        rows = self.maps.setdefault(name, [])
        return self._state(rows, get=lambda: iter(list(rows)), appendList=rows.extend, put=lambda x: rows.__setitem__(slice(None), x), clear=rows.clear)

    def listTimers(self):  # noqa: N802
        return iter(list(self.timers))

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def getMapState(self, name, shape, *ttl):  # noqa: N802
        m = self.maps.setdefault(name, {})
        return self._state(m, containsKey=lambda k: k in m, getValue=m.get, updateValue=m.__setitem__, removeKey=lambda k: m.pop(k, None), clear=m.clear, iterator=lambda: iter(list(m.items())), keys=lambda: iter(list(m)))


@pytest.mark.parametrize("most", [65_536, 50])
def test_waiting_pieces_take_few_calls(monkeypatch, most):
    """Pieces that wait are stored by blocks, not one by one; also where more wait than memory may hold."""
    monkeypatch.setattr(keyed, "MOST", most, raising=False)
    pieces = [(k, f"data: {k}\n\n", k == 999) for k in range(1000)]
    random.Random(4).shuffle(pieces)
    store, got = Store(), []
    for batch in (pieces[:400], pieces[350:700], pieces[700:]):
        parser = keyed.EventParser(None)
        parser.init(store)
        frames = [pd.DataFrame(batch[i : i + 60], columns=["seq", "piece", "last"]) for i in range(0, len(batch), 60)]
        got += [r for out in parser.handleInputRows(("s",), iter(frames), None) for r in out.itertuples(index=False)]
    assert [(r.stream_id, r.place, r.data) for r in got] == [("s", k, str(k)) for k in range(1000)]
    assert store.maps["early"] == {} and store.calls < (60 if most > 1000 else 400)


def test_waiting_runs_are_not_held_at_once():
    """A month of requests of one instance, all due with one timer: decided in order, with few of them in memory; what is not due yet waits on."""
    n, rng = 60_000, random.Random(5)
    rows = [(i * 43.25, i, f"u{i % 12}", (i % 7 + 1) * 9000.0) for i in range(n)]
    cut, store = rows[-100][0] + 1, Store()
    first, then = (limits.Admission(300, 4) for _ in range(2))
    first.init(store)
    mixed = rng.sample(rows, n)
    frames = [pd.DataFrame(mixed[i : i + 10_000], columns=["at", "event_id", "url", "seconds"]) for i in range(0, n, 10_000)]
    assert list(first.handleInputRows(("i",), iter(frames), None)) == []
    want, got = limits.decide([(at, url, s) for at, _, url, s in rows]), []
    time_of = lambda ms: type("T", (), {"getExpiryTimeInMs": lambda self: ms, "getCurrentWatermarkInMs": lambda self: ms})()
    tracemalloc.start()
    for pdf in first.handleExpiredTimer(("i",), time_of(cut * 1000), time_of(cut * 1000)):
        got += pdf["event_id"].tolist()
        assert list(zip(pdf["decision"], (None if x != x else x for x in pdf["started_at"]), strict=True)) == [want[e] for e in pdf["event_id"]]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == list(range(n - 99)) and peak < 8_000_000
    then.init(store)
    assert [e for pdf in then.handleExpiredTimer(("i",), time_of(1e12), time_of(1e12)) for e in pdf["event_id"]] == list(range(n - 99, n))
