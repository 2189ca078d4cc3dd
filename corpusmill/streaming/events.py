"""Server-sent events out of text chunks, and the splitter that holds back what may be a tool call."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import held

_LINE_END = re.compile(r"\r\n|\r|\n")


@dataclass
class Parser:
    """Lines end with LF, CR or CRLF, wherever chunks are cut; events without data are dropped.

    The pieces of a line that has not ended are kept as they came, and joined once: the whole is linear in the text. A
    CR that ends a chunk waits for what follows, for the next may begin with its LF.
    """

    parts: list[str] = field(default_factory=list)
    cr: bool = False
    event: str = ""
    id: str = ""
    data: list[str] = field(default_factory=list)

    def push(self, chunk: str, end: bool = False) -> list[tuple[str, str, str]]:
        out, at = [], 0
        if self.cr and (chunk or end):
            out += self._ended("")
            at, self.cr = int(chunk.startswith("\n")), False
        for m in _LINE_END.finditer(chunk, at):
            if m[0] == "\r" and m.end() == len(chunk) and not end:
                self.parts.append(chunk[at : m.start()])
                at, self.cr = len(chunk), True
                break
            out += self._ended(chunk[at : m.start()])
            at = m.end()
        if at < len(chunk):
            self.parts.append(chunk[at:])
        if end:
            out += (self._ended("") if any(self.parts) else []) + self._line("")
            self.parts = []
        return out

    def _ended(self, tail: str) -> list[tuple[str, str, str]]:
        line, self.parts = "".join([*self.parts, tail]), []
        return self._line(line)

    def _line(self, line: str) -> list[tuple[str, str, str]]:
        if line == "":
            done = [(self.event or "message", "\n".join(self.data), self.id)] if self.data else []
            self.event, self.data = "", []
            return done
        name, _, value = line.partition(":")
        value = value.removeprefix(" ")
        if name == "data":
            self.data.append(value)
        elif name == "event":
            self.event = value
        elif name == "id":
            self.id = value
        return []


def _in_streams(begin: Callable[[], object], step: Callable[[object, pd.DataFrame], list[tuple]], finish: Callable[[object], list[tuple]], columns: list[str]):
    """Goes through rows sorted by stream, frame after frame: of a stream only its state is held, however long it is."""

    def run(batches):
        stream, state, place = None, None, 0
        for pdf in batches:
            out = []

            def add(events: list[tuple]) -> None:
                nonlocal place
                out.extend((stream, place + i, *e) for i, e in enumerate(events))  # noqa: B023
                place += len(events)

            cuts = pdf["stream_id"].ne(pdf["stream_id"].shift()).cumsum()
            for _, part in pdf.groupby(cuts, sort=False):
                if state is None or part["stream_id"].iloc[0] != stream:
                    if state is not None:
                        add(finish(state))
                    stream, place = part["stream_id"].iloc[0], 0
                    state = begin()
                add(step(state, part))
            yield pd.DataFrame(out, columns=columns)
        if state is not None:
            yield pd.DataFrame([(stream, place + i, *e) for i, e in enumerate(finish(state))], columns=columns)

    return run


def parse(chunks: DataFrame) -> DataFrame:
    """stream_id, place, event, data, id of chunks(stream_id, seq, chunk); null chunks are empty, streams without an id are left out."""
    step = lambda parser, part: [e for c in part["chunk"] for e in parser.push(c if isinstance(c, str) else "")]
    run = _in_streams(Parser, step, lambda parser: parser.push("", end=True), ["stream_id", "place", "event", "data", "id"])
    rows = chunks.select("stream_id", "seq", "chunk").filter("stream_id is not null").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return rows.mapInPandas(run, "stream_id string, place int, event string, data string, id string")


def hold_back(pending: str, tail: int = 48) -> tuple[str, str]:
    """(what may be shown, what waits): text waits from the first < in the last characters on.

    Without one, where the first line speaks of a recipient but does not begin so, the end of that line waits with what
    follows; of a line that has not ended, its last character.
    """
    at = pending.find("<", max(0, len(pending) - tail))
    if at < 0:
        first, _, rest = pending.partition("\n")
        low = first.strip().lower()
        at = len(pending) - len(rest) - 1 if "recipient" in low and not low.startswith("recipient") else len(pending)
    return pending[:at], pending[at:]


@dataclass
class Answer:
    """An answer as it comes: deltas, held back where they may be a call of a tool, then exactly one end."""

    pending: str = ""
    shown: bool = False
    over: bool = False
    named: bool = False  # its sources have been given

    def push(self, piece: str | None) -> list[tuple[str, str]]:
        """The events of one more piece; a null one is where the stream broke."""
        if self.over:
            return []
        if piece is None:
            self.over = True
            return [("error", "broken"), ("done", "false")]
        show, self.pending = hold_back(self.pending + piece)
        self.shown = self.shown or bool(show)
        return [("delta", show)] if show else []

    def end(self) -> list[tuple[str, str]]:
        if self.over:
            return []
        out, self.over = [("delta", self.pending)] if self.pending else [], True
        return [*out, ("done", "true")] if self.shown or out else [("error", "empty"), ("done", "false")]


def fold(deltas: list[str | None]) -> list[tuple[str, str]]:
    """The events of an answer: deltas, then done; an empty stream is an error, and so is a broken one (None)."""
    answer = Answer()
    return [e for d in deltas for e in answer.push(d)] + answer.end()


def answer_events(deltas: DataFrame, sources: DataFrame) -> DataFrame:
    """stream_id, place, event, data of answers: their sources (JSON) first, then what ``fold`` makes of deltas(stream_id, seq, piece).

    sources(stream_id, file_path, place). A null piece is where a stream broke. A stream of sources alone is empty,
    and so an error. The pieces of an answer are read one after the other.
    """
    paths = F.transform(F.array_sort(F.collect_list(F.struct("place", "file_path"))), lambda x: x["file_path"])
    named = sources.groupBy("stream_id").agg(F.to_json(paths).alias("_sources"))

    def step(answer: Answer, part: pd.DataFrame) -> list[tuple[str, str]]:
        out = []
        for piece, seq, head in zip(part["piece"], part["seq"], part["_sources"], strict=True):
            if not answer.named:
                answer.named = True
                out.append(("sources", head if isinstance(head, str) else "[]"))
            if seq == seq and seq is not None:
                out += answer.push(piece if isinstance(piece, str) else None)
        return out

    run = _in_streams(Answer, step, Answer.end, ["stream_id", "place", "event", "data"])
    kind = dict(deltas.dtypes)["stream_id"]
    rows = deltas.select("stream_id", "seq", "piece").join(named, "stream_id", "full").filter("stream_id is not null").repartition("stream_id").sortWithinPartitions("stream_id", "seq")
    return rows.mapInPandas(run, f"stream_id {kind}, place int, event string, data string")


def subscribe(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    """subscriber, job, seq, message, replayed: every subscriber(subscriber, job, at) gets all messages(job, seq, at, message) of its job.

    Those before it came are replayed, in order, and the rest follows; so each sees the same sequence.
    """
    own = subscribers.select("subscriber", "job", F.col("at").alias("_since"))
    return messages.join(own, "job").select("subscriber", "job", "seq", "message", (F.col("at") < F.col("_since")).alias("replayed"))


def offsets(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    """subscriber, job, n_replayed, n_followed, first_followed of ``subscribe`` without its rows: how much of its job's log a subscriber is given.

    messages(job, seq, at), subscribers(subscriber, job, at). Both are put in one order of time for each job, messages of
    a subscriber's own instant after it, and counted as they pass; no message is joined to any subscriber. The order is
    cut into ranges, so that a job's log is not one task's: what lies before and after a range is told by the ranges' own
    counts and first messages. Both windows grow row by row; one that shrinks would be read again for each row.
    """
    both = messages.select("job", "at", F.lit(1).alias("_kind"), "seq", F.lit(None).alias("subscriber")).unionByName(
        subscribers.select("job", "at", F.lit(0).alias("_kind"), F.lit(None).cast(dict(messages.dtypes)["seq"]).alias("seq"), "subscriber")
    )
    # held, since ranges are drawn from a sample and must be the same for their sums and their rows
    ranged = held.cut(both.repartitionByRange("job", "at", "_kind", "seq").withColumn("_range", F.spark_partition_id()))
    time, back = ["at", "_kind", "seq"], [F.desc("at"), F.desc("_kind"), F.desc("seq")]
    said = F.when(F.col("seq").isNotNull(), F.struct(*time))
    sums = ranged.groupBy("job", "_range").agg(F.count("seq").alias("_n"), F.min(said)["seq"].alias("_first"))
    ranges, past = Window.partitionBy("job"), lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    around = sums.select(
        "job", "_range", F.coalesce(F.sum("_n").over(past(ranges.orderBy("_range"))), F.lit(0)).alias("_before"),
        F.last("_first", ignorenulls=True).over(past(ranges.orderBy(F.desc("_range")))).alias("_next"), F.sum("_n").over(ranges).alias("_all"),
    )
    own = Window.partitionBy("job", "_range")
    passed = ranged.withColumns({"_own": F.count("seq").over(past(own.orderBy(*time))), "_after": F.last("seq", ignorenulls=True).over(past(own.orderBy(*back)))}).filter("_kind = 0")
    n = F.col("_before") + F.col("_own")
    met = passed.withColumnRenamed("job", "_job").withColumnRenamed("_range", "_at_range").join(around, F.col("_job").eqNullSafe(F.col("job")) & (F.col("_at_range") == F.col("_range")))
    return met.select("subscriber", F.col("_job").alias("job"), n.alias("n_replayed"), (F.col("_all") - n).alias("n_followed"), F.coalesce("_after", "_next").alias("first_followed"))


def frame(event: Column, data: Column) -> Column:
    """An event as text: its name, a data line for each line, a blank line."""
    lines = F.transform(F.split(F.coalesce(data, F.lit("")), "\r\n|\r|\n"), lambda x: F.concat(F.lit("data: "), x))
    return F.concat(F.lit("event: "), event, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n\n"))


def sink(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a stream(stream_id, place, event, data) whose events reach ``write`` framed, batch after batch; a batch seen again has its number."""
    framed = stream.withColumn("frame", frame(F.col("event"), F.col("data")))
    return framed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def restarted(open_stream: Callable[[], Iterator[str]], attempts: int = 3, wait: Callable[[int], float] = lambda k: 0.0, sleep: Callable[[float], None] = time.sleep) -> Iterator[str]:
    """The pieces of a stream, opened again where it fails before its first piece; never after, for pieces would come twice."""
    for k in range(attempts):
        begun = False
        try:
            for piece in open_stream():
                begun = True
                yield piece
            return
        except Exception:
            if begun or k + 1 == attempts:
                raise
            sleep(wait(k))
