"""A work queue in the state store: each piece of work is tried until it succeeds or its tries are used up.

State is kept by (page, index): what is to be sent, how often it was tried, and a timer for the next try. A key that
succeeded is remembered for a time, so work that comes again meanwhile isn't done again; finished results are never read.
A query that is stopped, or loses an executor, goes on from its last batch: each key's result is told once, though a batch that
is run again calls its service again. A batch's keys are tried by all tasks, one call at a time in each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "page int, index int, raw string, error string, attempts int"


class Attempts(StatefulProcessor):
    """Tries a key's first crop; after a failure a timer brings the next try, after ``wait`` ms, twice that and so on."""

    def __init__(self, client: Callable[[str], str], retries: int, wait: int, remember: int):
        self.client, self.retries, self.wait, self.remember = client, retries, wait, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "crop string, attempts int")
        self.done = handle.getValueState("done", "attempts int", self.remember)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        crops = [r["crop"] for r in rows]
        if not self.open.exists() and not self.done.exists():
            least = min((c for c in crops if c is not None), default=None)  # of work that comes twice in a batch
            yield from self.attempt(key, least, 1, timerValues)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.open.exists():
            crop, attempts = self.open.get()
            yield from self.attempt(key, crop, attempts + 1, timerValues)

    def attempt(self, key, crop: str | None, attempts: int, now: TimerValues) -> Iterator[Row]:
        page, index = key
        try:
            if crop is None:
                raise ValueError("nothing to send")
            raw, error = self.client(crop), None
        except Exception as e:  # noqa: BLE001  a failed call is data here
            raw, error = None, str(e) or type(e).__name__
        if error is not None and crop is not None and attempts <= self.retries:
            self.open.update((crop, attempts))
            self.handle.registerTimer(now.getCurrentProcessingTimeInMs() + self.wait * 2 ** (attempts - 1))
            return
        self.open.clear()
        if error is None:
            self.done.update((attempts,))
        yield Row(page=page, index=index, raw=raw, error=error, attempts=attempts)

    def close(self) -> None:
        pass


def worked_off(work: DataFrame, client: Callable[[str], str], retries: int = 2, wait: int = 1000, remember: int = 7 * 24 * 3600 * 1000) -> DataFrame:
    """RESULT of a stream of work (page, index, crop), one row a key: its answer, or the last error after ``retries`` more tries.

    wait and remember are in ms; work of a key that succeeded is left out for ``remember`` ms, work of one that failed
    for good is tried anew when it comes again. A null crop is an error at once. The session's state store must be RocksDB (``PROVIDER``).
    """
    keyed = work.selectExpr("cast(page AS int) AS page", "cast(index AS int) AS index", "crop").groupBy("page", "index")
    return keyed.transformWithState(Attempts(client, retries, wait, remember), RESULT, "append", "ProcessingTime")


def start(work: DataFrame, client: Callable[[str], str], out: str, checkpoint: str, every: str = "1 second", **options):
    """The running query that writes results as Parquet, each once."""
    results = worked_off(work, client, **options)
    return results.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
