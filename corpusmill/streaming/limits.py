"""Admission: token buckets with keyed state, and coalescing of like requests."""

from __future__ import annotations

import bisect
import json
import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def take(tokens: float | None, updated: float, now: float, capacity: int, window: int) -> tuple[float, bool, float]:
    """(tokens left, allowed, seconds to wait) of one request; time never runs back."""
    filled = float(capacity) if tokens is None else min(float(capacity), tokens + max(0.0, now - updated) * capacity / window)
    return (filled - 1, True, 0.0) if filled >= 1 else (filled, False, max(1.0, (1 - filled) * window / capacity))


class Bucket(StatefulProcessor):
    """A row for each request: key, event_id, allowed, retry_after. Idle keys lose their state after ``idle_ms``."""

    def __init__(self, capacity: int, window: int, idle_ms: int | None = None):
        self.capacity, self.window, self.idle_ms = capacity, window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bucket", "tokens double, updated double", self.idle_ms)

    def handleInputRows(self, key, rows, timerValues):
        tokens, updated = self.state.get() if self.state.exists() else (None, 0.0)
        # a key's rows of one batch may come in several frames, and in any order
        pdf, out = pd.concat(list(rows)).sort_values(["at", "event_id"]), []
        for at, event in zip(pdf["at"].tolist(), pdf["event_id"].tolist(), strict=True):
            tokens, allowed, wait = take(tokens, updated, at, self.capacity, self.window)
            updated = max(updated, at)
            out.append((key[0], event, allowed, wait))
        yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "retry_after"])
        if tokens is not None:
            self.state.update((tokens, updated))

    def close(self) -> None:
        pass


OUT = "key string, event_id long, allowed boolean, retry_after double"


def limit(requests: DataFrame, capacity: int, window: int, idle_ms: int | None = None) -> DataFrame:
    """Decides requests(key, at in seconds, event_id), stream or batch; state is keyed, so the shuffle is by key."""
    if not requests.isStreaming:
        ordered = requests.select("key", "at", "event_id").repartition("key").sortWithinPartitions("key", "at", "event_id")
        return ordered.mapInPandas(_in_turn(capacity, window), OUT)
    return requests.groupBy("key").transformWithStateInPandas(Bucket(capacity, window, idle_ms), OUT, "Append", "ProcessingTime" if idle_ms else "None")


def _in_turn(capacity: int, window: int):
    """Sorted requests, key after key, frame after frame: of a key only its bucket is held, however many requests it has."""

    def run(batches):
        key, tokens, updated = None, None, 0.0
        for pdf in batches:
            out = []
            for k, at, event in zip(pdf["key"].tolist(), pdf["at"].tolist(), pdf["event_id"].tolist(), strict=True):
                if k != key:
                    key, tokens, updated = k, None, 0.0
                tokens, allowed, wait = take(tokens, updated, at, capacity, window)
                updated = max(updated, at)
                out.append((k, event, allowed, wait))
            yield pd.DataFrame(out, columns=["key", "event_id", "allowed", "retry_after"])

    return run


def coalesce(requests: DataFrame, keys: list[str], grace: str = "300 seconds") -> DataFrame:
    """Like requests within the grace start one run; requests(..., ts) is a stream."""
    return requests.withWatermark("ts", grace).dropDuplicatesWithinWatermark(keys)


# Seconds after its start in which a run is joined though it has ended, and runs at once.
GRACE, AT_ONCE = 300, 4


class Runs:
    """The runs of one instance: those that go on, and those that began less than ``grace`` ago."""

    def __init__(self, grace: float = GRACE, at_once: int = AT_ONCE, jobs: dict[str, tuple[float, float]] | None = None):
        self.grace, self.at_once, self.jobs = grace, at_once, dict(jobs or {})

    def ask(self, at: float, url: str, seconds: float) -> tuple[str, float | None]:
        """(started, attached or rejected; when its run began). A run that goes on or is young is joined; as many as ``at_once`` go on."""
        self.jobs = {u: j for u, j in self.jobs.items() if j[1] > at or at - j[0] <= self.grace}
        held = self.jobs.get(url)
        if held and (held[1] > at or at - held[0] < self.grace):
            return "attached", held[0]
        if sum(end > at for _, end in self.jobs.values()) >= self.at_once:
            return "rejected", None
        self.jobs[url] = (at, at + seconds)
        return "started", at


def decide(requests: list[tuple[float, str, float]], grace: float = GRACE, at_once: int = AT_ONCE) -> list[tuple[str, float | None]]:
    """``Runs.ask`` of each (at, url, seconds a run takes), in order of time."""
    runs = Runs(grace, at_once)
    return [runs.ask(*r) for r in requests]


#: Requests wait by spans of so many seconds, in pieces of at most so many.
SPAN, PIECE = 3600, 10_000


class Admission(StatefulProcessor):
    """Decisions of a stream of requests(instance, event_id, url, at, seconds, ts): those of one instance in order of time.

    Requests wait by spans of time until the watermark has passed them, so that they may come out of order within its
    delay; a timer at the earliest one's time then decides all that are due, span after span: of an instance's requests
    those of one span are in memory, however many wait. What is kept besides are the runs that still count.
    """

    def __init__(self, grace: float, at_once: int, span: int = SPAN):
        self.grace, self.at_once, self.span = grace, at_once, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getMapState("jobs", "url string", "began double, ends double")
        self.spans = handle.getValueState("spans", "spans string")
        self.waiting = handle.getMapState("waiting", "span long, piece long", "rows string")

    def _spans(self) -> dict[int, tuple[float, int]]:
        """The earliest request and the number of pieces of each span in which requests wait."""
        held = self.spans.get()
        return {int(k): tuple(v) for k, v in json.loads(held[0]).items()} if held else {}

    def handleInputRows(self, key, rows, timerValues):
        spans = self._spans()
        for pdf in rows:
            pdf = pdf[["at", "event_id", "url", "seconds"]]
            for span, part in pdf.groupby((pdf["at"] // self.span).astype("int64"), sort=False):
                self._keep(spans, int(span), list(zip(*(part[c].tolist() for c in part.columns), strict=True)))
        self.spans.update((json.dumps(spans),))
        self._wake(min(first for first, _ in spans.values()))
        yield from ()

    def _keep(self, spans: dict[int, tuple[float, int]], span: int, rows: list[tuple]) -> None:
        """Adds rows to a span, as pieces of their own."""
        first, n = spans.get(span, (math.inf, 0))
        first = min(first, min(r[0] for r in rows))
        for i in range(0, len(rows), PIECE):
            self.waiting.updateValue((span, n), (json.dumps(rows[i : i + PIECE]),))
            n += 1
        spans[span] = (first, n)

    def _take(self, span: int, n: int) -> list[tuple]:
        out = []
        for k in range(n):
            out += map(tuple, json.loads(self.waiting.getValue((span, k))[0]))
            self.waiting.removeKey((span, k))
        return sorted(out)

    def _wake(self, at: float, passed: int = -1) -> None:
        """One timer, at the earliest request that waits; those up to ``passed``, which are going off, do not count."""
        due, set_ = int(at * 1000) + 1, [t for t in self.handle.listTimers() if t > passed]
        if not set_ or due < min(set_):
            for timer in set_:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) / 1000
        spans = self._spans()
        ready = sorted(k for k, (first, _) in spans.items() if first < until)
        if not ready:
            return
        runs = Runs(self.grace, self.at_once, {k[0]: (v[0], v[1]) for k, v in self.jobs.iterator()})
        for span in ready:
            held = self._take(span, spans.pop(span)[1])
            due = bisect.bisect_left(held, (until,))
            if held[due:]:
                self._keep(spans, span, held[due:])
            out = [(key[0], e, *runs.ask(at, url, seconds)) for at, e, url, seconds in held[:due]]
            for i in range(0, len(out), PIECE):
                yield pd.DataFrame(out[i : i + PIECE], columns=["instance", "event_id", "decision", "started_at"])
        self.jobs.clear()
        for url, job in runs.jobs.items():
            self.jobs.updateValue((url,), job)
        self.spans.update((json.dumps(spans),))
        if spans:
            self._wake(min(first for first, _ in spans.values()), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def admit_runs(requests: DataFrame, grace: float = GRACE, at_once: int = AT_ONCE, delay: str = "300 seconds") -> DataFrame:
    """requests(instance, event_id, url, at, seconds) with decision and started_at; the runs of an instance are one sequence.

    A batch is sorted by instance and time and read through, of an instance only the runs that count being held. A stream
    has ts beside at, and its requests may come as late as ``delay``.
    """
    names = ["instance", "event_id", "decision", "started_at"]
    shape = f"instance {dict(requests.dtypes)['instance']}, event_id long, decision string, started_at double"
    if requests.isStreaming:
        return requests.withWatermark("ts", delay).groupBy("instance").transformWithStateInPandas(Admission(grace, at_once), shape, "Append", "EventTime")

    def run(batches):
        instance, runs = None, None
        for pdf in batches:
            out = []
            for key, event, url, at, seconds in zip(*(pdf[c].tolist() for c in ("instance", "event_id", "url", "at", "seconds")), strict=True):
                if runs is None or key != instance:
                    instance, runs = key, Runs(grace, at_once)
                out.append((key, event, *runs.ask(at, url, seconds)))
            yield pd.DataFrame(out, columns=names)

    rows = requests.select("instance", "event_id", "url", "at", "seconds").repartition("instance").sortWithinPartitions("instance", "at", "event_id")
    return rows.mapInPandas(run, shape)
