"""Streams that keep a state for each key: events out of chunks, answers with an end that is sure to come, logs that late subscribers are given once."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import Answer, Parser

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Pieces of a stream that wait are kept by blocks of so many places, and no more of them than so many in memory.
BLOCK, MOST = 256, 65_536


class _InOrder(StatefulProcessor):
    """Takes the pieces of each stream by seq, from 0 on: one that comes before its turn waits, one that comes again is passed over.

    Subclasses say what reads a stream (``reader``, a dataclass of JSON values), what a piece gives (``step``), and how a
    stream ends that falls silent (``broken``). State is one JSON text for each stream, and one for each block of the pieces
    that wait: every call of the store is a message to the JVM, so there is one for many pieces.
    """

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "at long, place int, over boolean, held string, blocks int")
        self.early = handle.getMapState("early", "block long", "pieces string")

    def handleInputRows(self, key, rows, timerValues):
        at, place, over, held, blocks = self.state.get() or (0, 0, False, None, 0)
        reader = self.reader(**json.loads(held)) if held else self.reader()
        waiting, looked = {}, None
        for pdf in rows:
            if over:
                continue
            waiting.update((int(q), (p if isinstance(p, str) else None, bool(z))) for q, p, z in zip(pdf["seq"].tolist(), pdf["piece"].tolist(), pdf["last"].tolist(), strict=True) if q >= at)
            out = []
            while not over:
                if at not in waiting and blocks and looked != at // BLOCK:
                    looked = at // BLOCK
                    known = self._block(looked)
                    if known:
                        self.early.removeKey((looked,))
                        blocks, waiting = blocks - 1, {q: v for q, v in known.items() if q >= at} | waiting
                if at not in waiting:
                    break
                made, over = self.step(reader, *waiting.pop(at))
                out += made
                at += 1
            if out:
                yield self._rows(key, place, out)
                place += len(out)
            if len(waiting) > MOST and not over:
                blocks, waiting, looked = blocks + self._keep(waiting), {}, None
        if not over:
            blocks += self._keep(waiting)
        elif blocks:
            self.early.clear()
            blocks = 0
        self.state.update((at, place, over, json.dumps(reader.__dict__), blocks))
        if self.idle_ms:
            for timer in self.handle.listTimers():
                self.handle.deleteTimer(timer)
            if not over:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def _block(self, k: int) -> dict[int, tuple[str | None, bool]]:
        kept = self.early.getValue((k,))
        return {int(q): tuple(v) for q, v in json.loads(kept[0]).items()} if kept else {}

    def _keep(self, waiting: dict[int, tuple[str | None, bool]]) -> int:
        """Adds pieces to their blocks; how many blocks are new."""
        new, parts = 0, {}
        for q, value in waiting.items():
            parts.setdefault(q // BLOCK, {})[q] = value
        for k, part in parts.items():
            known = self._block(k)
            new += not known
            self.early.updateValue((k,), (json.dumps(known | part),))
        return new

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        """Nothing came for too long: the stream ends here, as broken."""
        state = self.state.get()
        if state and not state[2]:
            at, place, _, held, _ = state
            reader = self.reader(**json.loads(held))
            out = self.broken(reader)
            self.early.clear()
            self.state.update((at, place + len(out), True, json.dumps(reader.__dict__), 0))
            yield self._rows(key, place, out)

    def _rows(self, key, place: int, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], place + i, *e) for i, e in enumerate(out)], columns=self.columns)

    def close(self) -> None:
        pass


class EventParser(_InOrder):
    columns, reader = ["stream_id", "place", "event", "data", "id"], Parser

    def step(self, parser: Parser, piece: str | None, last: bool) -> tuple[list[tuple], bool]:
        return parser.push(piece or "", end=last), last

    def broken(self, parser: Parser) -> list[tuple]:
        return parser.push("", end=True)


class AnswerEvents(_InOrder):
    columns, reader = ["stream_id", "place", "event", "data"], Answer

    def step(self, answer: Answer, piece: str | None, last: bool) -> tuple[list[tuple], bool]:
        if answer.named:
            out = answer.push(piece)
        else:
            answer.named, out = True, [("sources", piece or "[]")]  # the first piece of an answer is its sources
        out += answer.end() if last else []
        return out, answer.over

    def broken(self, answer: Answer) -> list[tuple]:
        return answer.push(None)


def _time_mode(idle_ms: int | None) -> str:
    return "ProcessingTime" if idle_ms else "None"


def parsed(chunks: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """stream_id, place, event, data, id of a stream of chunks(stream_id, seq from 0, piece, last), as ``events.parse`` has them.

    Chunks may come in any order and again; a stream ends with its last chunk, or ``idle_ms`` after the latest.
    """
    shape = "stream_id string, place int, event string, data string, id string"
    return chunks.select("stream_id", "seq", "piece", "last").groupBy("stream_id").transformWithStateInPandas(EventParser(idle_ms), shape, "Append", _time_mode(idle_ms))


def answered(pieces: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """stream_id, place, event, data of a stream of pieces(stream_id, seq from 0, piece, last); piece 0 is the answer's sources, a null one its break.

    Every answer gets one end: done, or error and done: false where it is empty, broken, or silent for ``idle_ms``.
    """
    shape = "stream_id string, place int, event string, data string"
    return pieces.select("stream_id", "seq", "piece", "last").groupBy("stream_id").transformWithStateInPandas(AnswerEvents(idle_ms), shape, "Append", _time_mode(idle_ms))


class Log(StatefulProcessor):
    """A job's messages, kept in order of arrival, and how much of them each subscriber was given."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.log = handle.getListState("log", "seq long, message string")
        self.given = handle.getMapState("given", "subscriber string", "n long")

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows))
        said = pdf[pdf["subscriber"].isna()].sort_values("seq")
        fresh = [(int(s), m) for s, m in zip(said["seq"], said["message"], strict=True)]
        known = [k[0] for k in self.given.keys()]
        came = [s for s in dict.fromkeys(pdf["subscriber"].dropna().tolist()) if s not in set(known)]
        before = list(self.log.get()) if came else []
        out = [(key[0], s, q, m, True) for s in came for q, m in before]
        out += [(key[0], s, q, m, False) for s in [*known, *came] for q, m in fresh]
        if fresh:
            self.log.appendList(fresh)
        for s in came:
            self.given.updateValue((s,), (len(before),))
        yield pd.DataFrame(out, columns=["job", "subscriber", "seq", "message", "replayed"])

    def close(self) -> None:
        pass


def subscriptions(rows: DataFrame) -> DataFrame:
    """job, subscriber, seq, message, replayed of a stream of rows(job, seq, message, subscriber): messages, or, with a subscriber, who joins.

    Who joins gets what earlier batches brought, once, then only what is new; who joins again gets nothing twice.
    """
    shape = f"job {dict(rows.dtypes)['job']}, subscriber string, seq long, message string, replayed boolean"
    return rows.select("job", "seq", "message", "subscriber").groupBy("job").transformWithStateInPandas(Log(), shape, "Append", "None")


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share: below spark.checkpoint.dir, or, on a local master without one, a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusmill-streams-")
    return os.path.join(root, f"{label}-{uuid.uuid4().hex}")


def replayed(batches: list[DataFrame], make: Callable[[DataFrame], DataFrame], label: str) -> DataFrame:
    """What a stream gives whose source has ``batches`` one after the other: each a micro-batch, the query started anew for each from its checkpoint."""
    spark = batches[0].sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    folder = work_folder(spark, label)
    schema = batches[0].schema
    for batch in batches:
        batch.write.mode("append").parquet(f"{folder}/in")
        made = make(spark.readStream.schema(schema).parquet(f"{folder}/in"))
        made.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{folder}/out")
