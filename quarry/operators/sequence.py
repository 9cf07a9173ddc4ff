"""Ordered operators. Input order is a column; nothing relies on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, order: str, keys: tuple[str, ...] = (), name: str = "number", width: int = 1 << 16) -> DataFrame:
    """1..n by ``order`` inside each key (or over all rows), counted in two levels so that no key needs one task.

    Blocks of ``width`` order values are counted, a window over the counts gives each block's start, and rows are
    numbered inside their block. Equal order values are numbered in an arbitrary but gapless way.
    """
    block = F.floor(F.col(order) / width).alias("_block")
    counts = rows.select(*keys, block).groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_block").eqNullSafe(F.col("_b"))
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = Window.partitionBy(*keys, "_block").orderBy(order)
    out = rows.withColumn("_block", F.floor(F.col(order) / width)).join(starts, same).withColumn(name, F.col("_start") + F.row_number().over(inside))
    return out.select(*rows.columns, name)


def numbered_within(rows: DataFrame, outer: str, inner: str, name: str = "number") -> DataFrame:
    """1..n over all rows by (outer, inner): numbered inside each outer value, on from the rows of those before it.

    Values may be of any size, and one outer value may hold most rows. The outer values' counts are summed by blocks first.
    """
    counts = rows.groupBy(F.col(outer).alias("_outer")).agg(F.count("*").alias("_n")).withColumn("_block", F.floor(F.col("_outer") / 4096))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy(F.col("_block").alias("_of")).agg(F.sum("_n").alias("_sum")).withColumn("_before", F.coalesce(F.sum("_sum").over(earlier(Window.orderBy("_of"))), F.lit(0)))
    starts = counts.withColumn("_inside", F.coalesce(F.sum("_n").over(earlier(Window.partitionBy("_block").orderBy("_outer"))), F.lit(0)))
    starts = starts.join(blocks, F.col("_block").eqNullSafe(F.col("_of"))).select("_outer", (F.col("_inside") + F.col("_before")).alias("_first"))
    joined = numbered(rows, inner, (outer,), name).join(starts, F.col(outer).eqNullSafe(F.col("_outer")))
    return joined.select(*rows.columns, (F.col(name) + F.col("_first")).alias(name))


def running_start(counts: DataFrame, order: str, count: str, first: int = 1, keys: tuple[str, ...] = (), name: str = "start") -> DataFrame:
    """The number at which each page's run begins: ``first`` plus the counts of the pages before."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn(name, first + F.coalesce(F.sum(count).over(before), F.lit(0)))


def filled_forward(rows: DataFrame, value: str, order: str, keys: tuple[str, ...], default, name: str) -> DataFrame:
    """The last value that isn't null up to each row, or the default."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(upto), F.lit(default)))


def filled_gaps(pages: DataFrame, keys: tuple[str, ...] = (), page: str = "page", numbers: str = "numbers") -> DataFrame:
    """Pages without numbers get an even, half-even rounded share of those missing between their known neighbours, in order."""
    w = Window.partitionBy(*keys).orderBy(page)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    known = F.when(F.size(numbers) > 0, F.struct(F.col(page).alias("p"), F.element_at(numbers, -1).alias("last"), F.element_at(numbers, 1).alias("first")))
    rows = pages.withColumn("_known", known)
    rows = rows.withColumn("_prev", F.last("_known", True).over(back)).withColumn("_next", F.first("_known", True).over(ahead))
    gap, low, high = F.col("_next.p") - F.col("_prev.p") - 1, F.col("_prev.last") + 1, F.col("_next.first") - 1
    missing = high - low + 1
    share = F.bround(missing / gap).cast("int")
    start = low + (F.col(page) - F.col("_prev.p") - 1) * share
    end = F.least(start + share - 1, high)
    fill = F.when((gap > 0) & (missing >= gap), F.when(start <= end, F.sequence(start.cast("int"), end.cast("int"))).otherwise(F.array().cast("array<int>")))
    return rows.withColumn(numbers, F.coalesce(numbers, fill)).drop("_known", "_prev", "_next")


def regions(markers: DataFrame, keys: tuple[str, ...], y: str, height: Column, above: int = 10, below: int = 4) -> DataFrame:
    """top and bottom of each marker's region: a little above it, down to just above the next marker or the page's end."""
    w = Window.partitionBy(*keys).orderBy(y)
    return markers.withColumn("top", F.greatest(F.lit(0), F.col(y) - above)).withColumn("bottom", F.coalesce(F.lead(y).over(w) - below, height))


def cluster_starts(values: Column, tolerance: int = 60) -> Column:
    """Starts of groups of an array's sorted values: a value joins while it is within the tolerance of the group's first."""
    return F.aggregate(F.array_sort(values), F.slice(values, 1, 0), lambda s, v: F.when((F.size(s) > 0) & (v - F.element_at(s, -1) <= tolerance), s).otherwise(F.array_append(s, v)))


def thinned(boxes: Column, gap: int = 150) -> Column:
    """Of an array of (y, h), those at least ``gap`` below the bottom of the last kept one."""
    last = lambda s: F.element_at(s, -1)
    return F.aggregate(F.array_sort(boxes), F.slice(boxes, 1, 0), lambda s, b: F.when((F.size(s) > 0) & (b["y"] - (last(s)["y"] + last(s)["h"]) < gap), s).otherwise(F.array_append(s, b)))
