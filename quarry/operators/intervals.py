"""Interval joins by equality: ranges are cut into aligned bins whose sizes are powers of two, so a value meets a range in one bin.

A range [start, end] of n values is covered exactly by at most 2 * log2(n) bins, each of 2**level units; ``width`` values make
a unit. What sticks out at both ends of the outermost whole units is told by a residual test, so with width 1 there is
none. Of the ranges that cover one whole bin only the first counts, so a million ranges over one value are one row there.
A value asks the bins it stands in, one a level, and takes the first of the answers. No join but on equality, and
neither side is exploded to its values or walked by every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(low: Column, high: Column) -> Column:
    """(level, bin) of the aligned bins that cover the units low..high-1 exactly; none where low >= high."""
    levels = F.sequence(F.lit(0), F.length(F.bin(high - low)))

    def at(level: Column) -> Column:
        size = _power(level)
        first, after = -_floor_div(-low, size), _floor_div(high, size)
        odd = lambda n: F.pmod(n, F.lit(2)) == 1
        ends = F.array(F.when(odd(first), first), F.when(odd(after), after - 1))
        return F.when(first < after, F.transform(F.filter(ends, lambda b: b.isNotNull()), lambda b: F.struct(level.cast("int").alias("level"), b.alias("bin"))))

    found = F.transform(levels, at)
    return F.when(low < high, F.flatten(F.filter(found, lambda x: x.isNotNull())))


def _power(level: Column) -> Column:
    return F.pow(F.lit(2), level).cast("long")  # exact up to 2**62


def _floor_div(a: Column, size: Column) -> Column:
    """Exact for 64-bit integers of either sign."""
    return F.call_function("div", a - F.pmod(a, size), size)


def covers(ranges: DataFrame, value: str = "name", width: int = 1) -> tuple[DataFrame, DataFrame]:
    """(level, bin, ord, value) of whole bins with the first range of each; (unit, start, end, ord, value) of the ends beyond them.

    ranges: (start, end, ord, value), both ends included; a range without start or end, or that ends before it starts, holds nothing.
    """
    rows = ranges.where(F.col("start") <= F.col("end")).select(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "ord", F.col(value).alias("_value"))
    w = F.lit(width).cast("long")
    low, high = -_floor_div(-F.col("start"), w), _floor_div(F.col("end") + 1, w)
    cut = rows.withColumns({"_low": low, "_high": high})
    whole = cut.select("ord", "_value", F.explode(_bins(F.col("_low"), F.col("_high"))).alias("_b")).groupBy("_b.level", "_b.bin").agg(F.min(F.struct("ord", "_value")).alias("_first"))
    # the units that hold the ends but aren't whole; for width 1 there are none
    first, last = _floor_div(F.col("start"), w), _floor_div(F.col("end"), w)
    sticks = F.array_distinct(F.filter(F.array(first, last), lambda u: (u < F.col("_low")) | (u >= F.col("_high"))))
    ends = cut.select("start", "end", F.struct("ord", "_value").alias("_first"), F.explode(sticks).alias("_unit"))
    return whole.select("level", "bin", "_first"), ends


def first_range(rows: DataFrame, ranges: DataFrame, at: str, name: str, default=None, value: str = "name", width: int = 1) -> DataFrame:
    """Each row with the ``value`` of the first closed range (start, end, ord, value) that holds its value, or the default.

    First by ord, then by the value itself where ranges share their ord. A null value is in no range. Rows stay as they
    are, however often they repeat; each different value is looked up once. Values and ends are integers.
    """
    whole, ends = covers(ranges, value, width)
    asked = rows.select(F.col(at).cast("long").alias("_at")).where("_at is not null").distinct()
    unit = _floor_div(F.col("_at"), F.lit(width).cast("long"))
    top = whole.agg(F.max("level")).scalar()
    size = _power(F.col("_level"))
    probes = asked.select("_at", F.explode(F.sequence(F.lit(0), F.coalesce(top, F.lit(0)))).alias("_level"), unit.alias("_unit")).select("_at", "_level", _floor_div(F.col("_unit"), size).alias("_bin"))
    found = probes.join(whole, (F.col("_level") == F.col("level")) & (F.col("_bin") == F.col("bin"))).select("_at", "_first")
    if width > 1:
        tested = asked.withColumn("_own", unit).join(ends, (F.col("_own") == F.col("_unit")) & F.col("_at").between(F.col("start"), F.col("end")))
        found = found.unionByName(tested.select("_at", "_first"))
    answers = found.groupBy("_at").agg(F.min("_first")["_value"].alias("_found"))
    joined = rows.join(answers, F.col(at).cast("long") == F.col("_at"), "left")
    return joined.select(*(F.col(c) for c in rows.columns if c != name), F.coalesce("_found", F.lit(default)).alias(name))


def holding(rows: DataFrame, ranges: DataFrame, at: str, columns: tuple[str, ...], width: int = 1) -> DataFrame:
    """All pairs of a row and a range that holds its value, with these columns of the range; as many rows as there are pairs.

    Each pair is told once: the bins of one range don't overlap.
    """
    side = ranges.where(F.col("start") <= F.col("end")).select(F.col("start").cast("long").alias("_start"), F.col("end").cast("long").alias("_end"), F.struct(*columns).alias("_range"))
    w = F.lit(width).cast("long")
    outer = _bins(_floor_div(F.col("_start"), w), _floor_div(F.col("_end"), w) + 1)
    bins = side.select("_start", "_end", "_range", F.explode(outer).alias("_b")).select("_start", "_end", "_range", F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin"))
    top = bins.agg(F.max("_level")).scalar()
    unit = _floor_div(F.col(at).cast("long"), w)
    probes = rows.where(F.col(at).isNotNull()).withColumn("_probe", F.explode(F.sequence(F.lit(0), F.coalesce(top, F.lit(0)))))
    size = _power(F.col("_probe"))
    same = (F.col("_probe") == F.col("_level")) & (F.col("_place") == F.col("_bin")) & F.col(at).between(F.col("_start"), F.col("_end"))
    return probes.withColumn("_place", _floor_div(unit, size)).join(bins, same).select(*(F.col(c) for c in rows.columns), *(F.col(f"_range.{c}").alias(c) for c in columns))
