"""Messages about a run, for whoever listens; a listener that fails does not fail the run."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener

_log = logging.getLogger("corpusmill")


def reporter(callback: Callable[[str], None] | None = None) -> Callable[[str], None]:
    """A function that logs a message and hands it to ``callback``."""

    def report(message: str) -> None:
        _log.info(message)
        if callback is not None:
            try:
                callback(message)
            except Exception as e:  # noqa: BLE001  the run goes on
                _log.warning("a listener failed: %s", e)

    return report


class Listener(StreamingQueryListener):
    """Reports the start, the rows of each batch and the end of streaming queries."""

    def __init__(self, callback: Callable[[str], None]):
        self.report = reporter(callback)

    def onQueryStarted(self, event) -> None:
        self.report(f"started {event.name or event.id}")

    def onQueryProgress(self, event) -> None:
        self.report(f"batch {event.progress.batchId}: {event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.report("failed" if event.exception else "ended")


def listen(spark: SparkSession, callback: Callable[[str], None]) -> Listener:
    listener = Listener(callback)
    spark.streams.addListener(listener)
    return listener
