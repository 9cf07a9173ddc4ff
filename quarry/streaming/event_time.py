"""Windows and joins by event time; the same functions take a stream, with watermarks that bound its state, or a batch.

On a stream a row that comes later than the watermark allows is dropped and counted (``LateRows``); what is in time gives the
rows that the batch gives. A window's row, and a row that no partner came for, is told once the watermark has passed it.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def _watched(rows: DataFrame, at: str, delay: str | None) -> DataFrame:
    return rows.withWatermark(at, delay) if delay else rows


def _counted(rows: DataFrame, window: Column, keys: tuple[str, ...], measures: dict[str, Column]) -> DataFrame:
    found = rows.groupBy(window.alias("_w"), *keys).agg(F.count("*").alias("n"), *(c.alias(name) for name, c in measures.items()))
    return found.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", *measures)


def sliding(rows: DataFrame, at: str, size: str, slide: str | None = None, keys: tuple[str, ...] = (), delay: str | None = None, **measures: Column) -> DataFrame:
    """(keys, start, end, n, measures) of each window of ``size``, a new one every ``slide`` (else one after another).

    A row without a time is in no window; null keys are a group. delay: how late a row of a stream may come.
    """
    return _counted(_watched(rows, at, delay).where(F.col(at).isNotNull()), F.window(at, size, slide or size), keys, measures)


def sessions(rows: DataFrame, at: str, gap: str, keys: tuple[str, ...], delay: str | None = None, **measures: Column) -> DataFrame:
    """(keys, start, end, n, measures) of each session: rows of a key less than ``gap`` apart; it ends a gap after its last row."""
    return _counted(_watched(rows, at, delay).where(F.col(at).isNotNull()), F.session_window(at, gap), keys, measures)


def joined_within(left: DataFrame, right: DataFrame, keys: tuple[str, ...], left_at: str, right_at: str, before: str, after: str, how: str = "inner", left_delay: str | None = None, right_delay: str | None = None) -> DataFrame:
    """Rows of equal keys whose right time is from ``before`` before to ``after`` after the left one, both ends included.

    how: inner or left_outer; then a left row without a partner is told with nulls, on a stream when none can come any
    more. Both streams' delays and the range bound what is kept. Columns of the right side other than the keys must have other
    names than the left's. Null keys and times have no partner.
    """
    if how not in ("inner", "left_outer"):
        raise ValueError("how is inner or left_outer")
    named = {k: f"_right_{k}" for k in keys}
    right = _watched(right, right_at, right_delay).withColumnsRenamed(named)
    left = _watched(left, left_at, left_delay)
    same = F.col(right_at).between(F.col(left_at) - F.expr(f"INTERVAL {before}"), F.col(left_at) + F.expr(f"INTERVAL {after}"))
    for k, other in named.items():
        same = same & (F.col(k) == F.col(other))
    return left.join(right, same, how).drop(*named.values())


class LateRows(StreamingQueryListener):
    """Adds up the rows that queries dropped as too late, by the query's id, over all its batches."""

    def __init__(self):
        self.dropped: dict[str, int] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        with self._lock:
            self.dropped.setdefault(str(event.id), 0)

    def onQueryProgress(self, event) -> None:
        late = sum(o.numRowsDroppedByWatermark for o in event.progress.stateOperators)
        with self._lock:
            self.dropped[str(event.progress.id)] = self.dropped.get(str(event.progress.id), 0) + late

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
