"""Greedy choices along an order, for groups of any length: a block of values is walked by one task, blocks are joined.

Which value follows if this one is chosen doesn't hang on the choices before. The values are put in one order and cut into
blocks of ``1 << BITS``. In a block each value knows the reach with which the choices from it on leave the block; few
reaches differ. They are the nodes of a small table: a reach enters a later block at the first value that it allows and
leaves it with another one. This table is joined to itself, so that it leads 2, 4, 8, ... blocks on; each time the nodes
known so far double. Then every block is walked from the node that enters it. Values are shuffled a fixed number of times
however long a group is, and only reaches are joined round after round.

``sequence.thinned`` and ``sequence.cluster_starts`` do the same for a group that is one array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof
from .tables import Run

#: a block has 1 << BITS values
BITS = 18


def _blocks(batches):
    """The batches' rows as one table for each run of equal ``_block``."""
    held, at = [], None
    for batch in batches:
        block = batch.column("_block").to_numpy()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if held and block[a] != at:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(a, b - a))
            at = block[a]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each different value, null among them."""
    if pa.types.is_nested(column.type):
        column = pa.chunked_array([pa.array(map(repr, column.to_pylist()))])
    return column.combine_chunks().dictionary_encode("encode").indices.to_numpy()


def _ahead(v: np.ndarray, r: np.ndarray, begins: np.ndarray, side: str):
    """For sorted values of groups that begin there: what follows each, whether its choices end at it, and at which value those from each on end."""
    n = len(v)
    ends = np.append(begins[1:], n)
    after = np.empty(n, np.int64)
    for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
        after[a:b] = a + np.searchsorted(v[a:b], r[a:b], side)
    here = np.arange(n)
    # a reach up to the value itself would choose it again
    stops = (after <= here) | (after >= np.repeat(ends, ends - begins))
    last = np.where(stops, here, after)
    while True:
        then = last[last]
        if (then == last).all():
            return after, stops, last
        last = then


def _walk(after: np.ndarray, stops: np.ndarray, starts) -> np.ndarray:
    picked = np.zeros(len(after), bool)
    after, stops = after.tolist(), stops.tolist()
    for i in starts:
        while not stops[i]:
            picked[i] = True
            i = after[i]
        picked[i] = True
    return picked


def _at(column, rows: np.ndarray, of: np.ndarray, n: int):
    """n values: at ``rows`` the column's values ``of``, else null."""
    index = np.full(n, -1)
    index[rows] = of
    return column.take(pa.array(index, mask=index < 0))


def _settle(names: list[str], side: str):
    def run(batches):
        for t in _blocks(batches):
            n = t.num_rows
            new = np.zeros(n, bool)
            new[0] = True
            for name in names:
                codes = _codes(t[name])
                new[1:] |= codes[1:] != codes[:-1]
            begins, group = np.flatnonzero(new), np.cumsum(new) - 1
            after, stops, last = _ahead(t["_v"].to_numpy(), t["_r"].to_numpy(), begins, side)
            picked = _walk(after, stops, begins[1:].tolist())
            # only the last group goes on in another block
            own = int(begins[-1])
            end = last[own:]
            leaving = own + np.flatnonzero(after[end] >= n)
            _, first = np.unique(last[leaving], return_index=True)
            rows = leaving[first]
            exits = _at(t["_r"], rows, last[rows], n)
            lead = np.array([0, own])
            high = _at(t["_v"], lead, np.array([begins[1] - 1 if len(begins) > 1 else n - 1, n - 1]), n)
            out = t.append_column("_hi", high).append_column("_exit", exits).append_column("_group", pa.array(group.astype(np.int32))).append_column("_picked", pa.array(picked))
            needed = (group == 0) | picked
            needed[lead] = needed[rows] = True
            yield from out.filter(pa.array(needed)).to_batches(max_chunksize=1 << 16)

    return run


def _sorted(block: pa.Table, side: str):
    block = block.take(pa.array(np.argsort(block["_v"].to_numpy(), kind="stable")))
    return block, *_ahead(block["_v"].to_numpy(), block["_r"].to_numpy(), np.zeros(1, np.int64), side)


def _onward(names: list[str], side: str):
    """The reach with which the choices that enter a block by each asked reach leave it."""

    def run(block: pa.Table, asks: pa.Table) -> pa.Table:
        if not (block.num_rows and asks.num_rows):
            return pa.table({**{n: asks[n].slice(0, 0) for n in names}, "_from": asks["_ask"].slice(0, 0), "_to": block["_r"].slice(0, 0)})
        block, after, _, last = _sorted(block, side)
        end = last[np.searchsorted(block["_v"].to_numpy(), asks["_ask"].to_numpy(), side)]
        leaves = np.flatnonzero(after[end] >= len(after))
        some = asks.take(pa.array(leaves))
        return pa.table({**{n: some[n] for n in names}, "_from": some["_ask"], "_to": block["_r"].take(pa.array(end[leaves]))})

    return run


def _walked(names: list[str], side: str):
    """A block's choices from the reach that enters it, or from its first value where that is null."""

    def run(block: pa.Table, entry: pa.Table) -> pa.Table:
        picked = np.zeros(block.num_rows, bool)
        if block.num_rows and entry.num_rows:
            block, after, stops, _ = _sorted(block, side)
            reach = entry["_ask"].combine_chunks()
            start = 0 if reach.null_count else int(np.searchsorted(block["_v"].to_numpy(), reach.to_numpy(), side)[0])
            picked = _walk(after, stops, [start])
        return block.filter(pa.array(picked)).select([*names, "_v"])

    return run


def chosen(rows: DataFrame, keys: tuple[str, ...], value: str, reach: Column, exact: bool = True) -> DataFrame:
    """(keys, value) of each group's greedy choices: its least value, then always the first one at (or beyond) the last choice's ``reach``.

    exact: a value equal to the reach may follow; else only a greater one. reach is no less than its value; of equal
    values that with the least reach counts. Rows with a null value or reach are left out; null keys are a group.
    """
    run, rounds = Run(rows.sparkSession), Run(rows.sparkSession)
    names, side = [f"_g{i}" for i in range(len(keys))], "left" if exact else "right"
    one = rows.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), F.col(value).alias("_v"), reach.alias("_r")).where("_v is not null and _r is not null")
    one = one.groupBy(*names, "_v").agg(F.min("_r").alias("_r"))
    cut = one.repartitionByRange(*names, "_v").sortWithinPartitions(*names, "_v").withColumn("_block", F.shiftright(F.monotonically_increasing_id(), BITS))
    kind = {f.name: f.dataType for f in one.schema.fields}
    typed = lambda **c: ", ".join([*(f"{n} {kind[n].simpleString()}" for n in names), *(f"{n} {t}" for n, t in c.items())])
    v, r = kind["_v"].simpleString(), kind["_r"].simpleString()
    settled = run.settled(cut.mapInArrow(_settle(names, side), typed(_v=v, _r=r, _block="long", _hi=v, _exit=r, _group="int", _picked="boolean")))
    # the first row of a block's first and last group; the least of a group's is where it begins
    leads = settled.where("_hi is not null").select(*names, "_v", "_hi", "_block", "_exit", "_group")
    begin = run.settled(leads.groupBy(*names).agg(F.min_by(F.struct("_block", "_exit", "_group"), "_v").alias("_b")).select(*names, "_b.*"))
    exits = settled.where("_exit is not null").select(*names, F.col("_exit").alias("_ask")).distinct()
    nodes = asof(exits, leads.select(*names, "_hi", "_block"), "_ask", "_hi", tuple(names), ("_block",), direction="forward", exact=exact, run=run)
    nodes = run.settled(nodes.where("place is not null").select(*names, "_ask", "_block"))
    first = settled.where("_group = 0").select(*names, "_v", "_r", "_block")
    onward = first.groupBy("_block").cogroup(nodes.groupBy("_block")).applyInArrow(_onward(names, side), typed(_from=r, _to=r))
    steps = rounds.settled(onward)
    picked = rounds.settled(begin.where("_exit is not null").select(*names, F.col("_exit").alias("_ask")))
    while not steps.isEmpty():
        known = picked.select(*(F.col(n).alias(f"{n}_") for n in names), F.col("_ask").alias("_from_"))
        further = steps.join(known, _same(names) & (F.col("_from") == F.col("_from_"))).select(*names, F.col("_to").alias("_ask"))
        picked = rounds.settled(picked.unionByName(further))
        then = steps.select(*(F.col(n).alias(f"{n}_") for n in names), F.col("_from").alias("_from_"), F.col("_to").alias("_to_"))
        steps = rounds.settled(steps.join(then, _same(names) & (F.col("_to") == F.col("_from_"))).select(*names, "_from", F.col("_to_").alias("_to")))
        rounds.keep(2)  # the last choices and steps
    known = picked.select(*(F.col(n).alias(f"{n}_") for n in names), F.col("_ask").alias("_ask_"))
    entries = nodes.join(known, _same(names) & (F.col("_ask") == F.col("_ask_"))).select("_block", "_ask")
    entries = entries.unionByName(begin.where("_group = 0").select("_block", F.lit(None).cast(r).alias("_ask")))
    walked = first.groupBy("_block").cogroup(entries.groupBy("_block")).applyInArrow(_walked(names, side), typed(_v=v))
    picked = settled.where("_group > 0 and _picked").select(*names, "_v").unionByName(walked)
    return picked.select(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)), F.col("_v").alias(value))


def _same(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"{n}_"))
    return out


def thinned(boxes: DataFrame, keys: tuple[str, ...], y: str = "y", h: str = "h", gap: int = 150) -> DataFrame:
    """(keys, y) of the boxes at least ``gap`` below the bottom of the last kept one, from each group's topmost box on."""
    return chosen(boxes, keys, y, F.greatest(F.col(y), F.col(y) + F.col(h) + gap))


def clustered(rows: DataFrame, keys: tuple[str, ...], value: str, tolerance=60) -> DataFrame:
    """Each row with ``start``: its group's clusters begin where a value is over the tolerance beyond the last beginning. Null values have none."""
    starts = chosen(rows, keys, value, F.col(value) + tolerance, exact=False)
    return asof(rows, starts.withColumnRenamed(value, "_start"), value, "_start", keys, direction="backward").withColumnRenamed("place", "start").drop("distance")
