"""Embedding whitening by merging singular value decompositions.

Entries are counted in steps of 1/256 (x = floor(256 c)), so sums are exact. The fit list holds each distinct vector
once. Every task decomposes its share of the list batch by batch and keeps all singular values and vectors, the number of
vectors and their exact sum; two such states merge by stacking both scaled sets of vectors and one more row that
corrects for the different means, and decomposing again. Nothing is truncated, so the last state has the singular
values and vectors of the whole centred list, without a covariance being formed. States merge in a tree of ``fan`` by
task number; one holds d * d + 2 d numbers for d dimensions, whatever the rows.

Edge cases: rows whose vector is null or holds a null, NaN or infinite entry are left out; shorter vectors are continued
by zeros up to the longest. Without rows there is no result; a component without variance (at most 1e-12 of the first
singular value, so all of them where one distinct vector is left) has null as ``whitened``, and ``explained`` and
``identity_error`` are null where nothing varies. A deviation beyond a long is null. Repeated rows, and rows that repeat
an id or have none, are told row by row. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, stored, table

STATE = "part long, n long, total array<decimal(38,0)>, singular array<double>, vectors array<double>"
_TINY = 1e-12


@dataclass(frozen=True)
class State:
    """Of n vectors: their exact sum, and singular values and vectors (as rows) of the matrix less its mean."""

    n: int
    total: list[int]
    singular: np.ndarray
    vectors: np.ndarray

    def row(self, part: int) -> dict:
        return {"part": part, "n": self.n, "total": self.total, "singular": self.singular, "vectors": self.vectors.ravel()}


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(rows) > rows.shape[1]:
        rows = np.linalg.qr(rows, mode="r")  # the same singular values and right vectors
    _, singular, vectors = np.linalg.svd(rows, full_matrices=False)
    return singular, vectors


def off_mean(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """n * x - total, exactly: 64-bit integers where they hold it, else Python's."""
    most = max(int(np.abs(x).max(initial=0)), 0) * n + max(map(abs, total), default=0)
    return n * x - np.array(total, np.int64) if most < 1 << 62 else n * x.astype(object) - np.array(total, object)


def of_batch(x: np.ndarray) -> State:
    total = [int(t) for t in x.astype(object).sum(0)] if np.abs(x).max(initial=0) > (1 << 62) // max(len(x), 1) else x.sum(0).tolist()
    return State(len(x), total, *decomposed(off_mean(x, len(x), total).astype(float) / len(x)))


def merged(a: State, b: State) -> State:
    n = a.n + b.n
    between = np.array([s * b.n - t * a.n for s, t in zip(a.total, b.total, strict=True)], object).astype(float) / (a.n * b.n)
    correction = np.sqrt(a.n / n * b.n) * between  # what the two means add to the spread
    stacked = np.vstack([a.singular[:, None] * a.vectors, b.singular[:, None] * b.vectors, correction[None]])
    return State(n, [s + t for s, t in zip(a.total, b.total, strict=True)], *decomposed(stacked))


@dataclass(frozen=True)
class Whitening:
    """The fitted list: its size, exact sums, all eigenvalues, and unit eigenvectors as rows."""

    n: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray

    def scales(self, k: int) -> np.ndarray:
        """1 / sqrt(eigenvalue) of the first k components; NaN for those without variance."""
        root = np.sqrt(self.values[:k])
        return np.where(root > _TINY * root[:1], 1 / np.where(root > 0, root, 1), np.nan)

    def apply(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Deviations, where one fits a long, and k whitened values of each row."""
        off = off_mean(x, self.n, self.total)
        small = off.dtype == np.int64 and x.shape[1] * int(np.abs(off).max(initial=0)) ** 2 < 1 << 63
        square = (off**2).sum(1) if small else np.array([sum(int(v) ** 2 for v in row) for row in off], object)
        fits = square < 1 << 63
        return np.where(fits, square, 0).astype(np.int64), fits.astype(bool), (off.astype(float) / self.n) @ self.vectors[:k].T * self.scales(k)


def counted(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x) of the rows whose vector is whole: entries in steps of 1/256, all as long as the longest."""
    v = F.col(vector)
    broken = F.exists(v, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    rows = vectors.select(key, v).where(v.isNotNull() & ~broken).select(key, F.transform(v, lambda c: F.floor(c.cast("double") * 256)).alias("x"))
    least, most = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    return rows if least == most else rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("x"))))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    entries = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return entries.reshape(len(batch), len(entries) // max(len(batch), 1))


def _of_task(batches):
    state = None
    for batch in batches:
        if len(batch):
            one = of_batch(_matrix(batch))
            state = one if state is None else merged(state, one)
    if state is not None:
        yield _arrow([state.row(TaskContext.get().partitionId())])


def _arrow(rows: list[dict]) -> pa.RecordBatch:
    doubles, exact = pa.list_(pa.float64()), pa.list_(pa.decimal128(38, 0))
    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("total", exact), ("singular", doubles), ("vectors", doubles)])
    return pa.RecordBatch.from_pylist(rows, schema)


def _state(row) -> State:
    singular = np.asarray(row["singular"], float)
    total = [int(t) for t in row["total"]]
    return State(int(row["n"]), total, singular, np.asarray(row["vectors"], float).reshape(len(singular), len(total)))


def _merge(states: pd.DataFrame) -> pd.DataFrame:
    rows = [_state(r) for r in states.sort_values("part").to_dict("records")]
    out = rows[0]
    for one in rows[1:]:
        out = merged(out, one)
    return _arrow([out.row(int(states["up"].iloc[0]))]).to_pandas()


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct vector once, as a table."""
    return stored(rows.select("x").distinct(), "whitening-list")


def fit(distinct: DataFrame, fan: int = 8) -> Whitening | None:
    """None without vectors. Only the last state reaches the driver."""
    parts = distinct.rdd.getNumPartitions()
    states = distinct.mapInArrow(_of_task, STATE)
    while parts > 1:
        states = states.withColumn("up", F.floor(F.col("part") / fan)).groupBy("up").applyInPandas(_merge, STATE)
        parts = -(-parts // fan)
    found = states.collect()
    if not found:
        return None
    last = _state(found[0].asDict())
    largest = np.abs(last.vectors).argmax(1) if last.vectors.size else np.zeros(0, int)
    sign = np.where(last.vectors[np.arange(len(largest)), largest] < 0, -1.0, 1.0)  # the largest entry is positive
    more = len(last.total) - len(largest)  # fewer vectors than dimensions: the other components have no variance
    return Whitening(last.n, last.total, np.pad(last.singular**2 / last.n, (0, more)), np.pad(last.vectors * sign[:, None], ((0, more), (0, 0))))


def whitened(rows: DataFrame, model: Whitening, components: int, key: str | None = "vec_id") -> DataFrame:
    """(key, deviation, w) of (key, x): w has the row's first components, NaN for those without variance."""
    ids = [] if key is None else [key]

    def run(batches):
        for batch in batches:
            square, fits, w = model.apply(_matrix(batch), components)
            w = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ids), pa.array(square, mask=~fits), w], [*ids, "deviation", "w"])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ids), "deviation long, w array<double>"])
    return rows.select(*ids, "x").mapInArrow(run, schema)


def identity_error(distinct: DataFrame, model: Whitening, components: int) -> float | None:
    """The largest absolute entry of the whitened list's covariance less the identity, over components with variance."""
    kept = np.flatnonzero(np.isfinite(model.scales(components)))
    pairs = [(int(i), int(j)) for i in kept for j in kept if i <= j]
    if not pairs:
        return None
    w = lambda i: F.col("w")[i]
    entries = [F.abs(F.covar_pop(w(i), w(j)) - int(i == j)).alias(f"c{i}_{j}") for i, j in pairs]
    return float(max(whitened(distinct, model, components, None).agg(*entries).first()))


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    rows = counted(table(spark, sf_dir, "embeddings"))
    distinct = fit_list(rows)
    model = fit(distinct)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    components = 0 if model is None else min(4, len(model.values))
    if not components:
        drop(distinct)
        return spark.createDataFrame([], schema)
    error, trace = identity_error(distinct, model, components), float(model.values.sum())
    drop(distinct)
    shares = [float(v) / trace if trace > 0 else None for v in model.values[:components]]
    each = whitened(rows, model, components).select("vec_id", "deviation", F.posexplode("w").alias("k", "w"))
    explained = F.element_at(F.array(*(F.lit(s).cast("double") for s in shares)), F.col("k") + 1)
    value = F.when(~F.isnan("w"), F.col("w"))
    return each.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", value.alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"))
