"""Numpy arrays dealt from task to task: a row holds a bucket, what its arrays are (kind), who sent them, and up to four packed arrays.

Spark shuffles few long rows, and tasks work on whole arrays. A bucket's rows come in the order of (kind, source), so senders
and receivers that know the same sorted keys need not send them.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "bucket int, kind int, source int, a binary, b binary, c binary, d binary, x long, y long"
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("source", pa.int32()), *((c, pa.binary()) for c in "abcd"), ("x", pa.int64()), ("y", pa.int64())])


def rows(bucket: np.ndarray, kind: int, source: int, *arrays: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket with its parts of the arrays, their order kept."""
    narrow = bucket.astype(np.uint16) if len(bucket) and bucket.max() < 1 << 16 else bucket  # such are sorted by radix
    order = np.argsort(narrow, kind="stable")
    ranked = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    bounds, n = np.append(cut, len(ranked)), len(cut)
    packed = []
    for v in arrays:
        v = np.ascontiguousarray(v[order])
        packed.append(pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * (v.itemsize * (v.shape[1] if v.ndim > 1 else 1))).astype(np.int32)), pa.py_buffer(v)]))
    packed += [pa.nulls(n, pa.binary())] * (4 - len(arrays))
    same = lambda v, t: pa.array(np.full(n, v), t)
    return pa.RecordBatch.from_arrays([pa.array(ranked[cut].astype(np.int32)), same(kind, pa.int32()), same(source, pa.int32()), *packed, same(0, pa.int64()), same(0, pa.int64())], schema=_ARROW)


def row(bucket: int, kind: int, *arrays: np.ndarray, x: int = 0, y: int = 0) -> pa.RecordBatch:
    packed = [pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in arrays] + [pa.nulls(1, pa.binary())] * (4 - len(arrays))
    ints = [pa.array([v], t) for v, t in ((bucket, pa.int32()), (kind, pa.int32()), (bucket, pa.int32()))]
    return pa.RecordBatch.from_arrays([*ints, *packed, pa.array([x], pa.int64()), pa.array([y], pa.int64())], schema=_ARROW)


def met(df: DataFrame, buckets: int) -> DataFrame:
    """All rows of a bucket in one task, by (kind, source)."""
    return df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "source")


def each(work):
    """For mapInArrow over met() or stored rows: work(bucket, {kind: [(source, a, b, c, d as buffers)]}) yields batches."""

    def run(batches):
        now, held = None, defaultdict(list)
        for batch in batches:
            columns = [batch.column(c) for c in "abcd"]
            for i, (bucket, kind, source) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "source")), strict=True)):
                if now is not None and bucket != now:
                    yield from work(now, held)
                    held = defaultdict(list)
                now = bucket
                held[kind].append((source, *(c[i].as_buffer() for c in columns)))
        if now is not None:
            yield from work(now, held)

    return run


def small(counts: np.ndarray) -> np.ndarray:
    """Counts packed as a byte each, with those of 255 and more in full behind them."""
    counts = np.asarray(counts, np.int64)
    return np.concatenate([np.array([len(counts)]).view(np.uint8), np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].view(np.uint8)])


def counts(held: list, column: int) -> np.ndarray:
    """What small() packed, of all parts."""
    parts = []
    for r in held:
        n = int(np.frombuffer(r[column], np.int64, 1)[0])
        v = np.frombuffer(r[column], np.uint8, n, 8).astype(np.int64)
        v[v == 255] = np.frombuffer(np.frombuffer(r[column], np.uint8)[8 + n :].tobytes(), np.int64)
        parts.append(v)
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def joined(held: list, column: int, kind) -> np.ndarray:
    """One array of the packed parts of a column (1 to 4)."""
    parts = [np.frombuffer(r[column], kind) for r in held if r[column] is not None]
    return np.concatenate(parts) if parts else np.zeros(0, kind)
