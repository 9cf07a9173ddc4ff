"""Mergeable sketches kept per group: distinct values, quantiles and frequencies of groups of groups without their rows.

``sketched`` reads the rows once and leaves one state a group; ``merged`` makes the states of coarser groups from these
alone, and ``told`` and ``frequency`` read them. HyperLogLog errs by about 1.04 / sqrt(2**precision) (one standard
deviation), KLL's ranks by about 1.7 / k of the group's rows, count-min only upwards, by at most e / width of the rows with
probability 1 - exp(-depth). A hot group is one row for each task before anything meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATES = ("distinct", "ranks", "cells", "n")


def _cells(value: Column, width: int, depth: int) -> Column:
    """One cell for each of ``depth`` hashes."""
    return F.array(*((F.pmod(F.xxhash64(value, F.lit(i)), F.lit(width)) + i * width).cast("int") for i in range(depth)))


def _gathered(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, cells) of (keys, cell, n): the non-zero cells in order, at most depth * width of them."""
    summed = cells.groupBy(*keys, "cell").agg(F.sum("n").alias("n"))
    return summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cell", "n"))).alias("cells"))


def _beside(a: DataFrame, b: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    b = b.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return a.join(b, same, "left").drop(*(f"_{k}" for k in keys))


def sketched(rows: DataFrame, keys: tuple[str, ...], value: str, number: str, precision: int = 12, k: int = 200, width: int = 2048, depth: int = 5) -> DataFrame:
    """(keys, STATES): distinct ``value``s (HyperLogLog), ranks of ``number`` (KLL), frequencies of ``value`` (count-min), rows.

    Nulls count as rows only; a group without a value or number has null there. Null keys are a group.
    """
    kll = F.kll_sketch_agg_double(F.col(number).cast("double"), F.lit(k))
    hll = F.hll_sketch_agg(F.col(value), precision)
    states = rows.groupBy(*keys).agg(F.when(F.count(value) > 0, hll).alias("distinct"), F.when(F.count(number) > 0, kll).alias("ranks"), F.count("*").alias("n"))
    each = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    cells = _gathered(each.select(*keys, "n", F.explode(_cells(F.col(value), width, depth)).alias("cell")), keys)
    return _beside(states, cells, keys).select(*keys, *STATES)


def merged(states: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The same of coarser groups, from states alone."""
    up = states.groupBy(*keys).agg(F.when(F.count("distinct") > 0, F.hll_union_agg("distinct")).alias("distinct"), F.when(F.count("ranks") > 0, F.kll_merge_agg_double("ranks")).alias("ranks"), F.sum("n").alias("n"))
    cells = _gathered(states.select(*keys, F.explode("cells").alias("_c")).select(*keys, "_c.cell", "_c.n"), keys)
    return _beside(up, cells, keys).select(*keys, *STATES)


def told(states: DataFrame, keys: tuple[str, ...], ranks: tuple[float, ...] = (0.5,)) -> DataFrame:
    """(keys, n, n_distinct, quantiles): what the states say; 0 and null without a value or number."""
    quantiles = F.when(F.col("ranks").isNotNull(), F.array(*(F.kll_sketch_get_quantile_double("ranks", F.lit(r)) for r in ranks)))
    return states.select(*keys, "n", F.coalesce(F.hll_sketch_estimate("distinct"), F.lit(0)).cast("long").alias("n_distinct"), quantiles.alias("quantiles"))


def frequency(asked: DataFrame, states: DataFrame, keys: tuple[str, ...], value: str, width: int = 2048, depth: int = 5) -> DataFrame:
    """asked (keys, value, ...) with ``at_most``: how often the value stands in its group, never too few. width and depth as sketched."""
    cells = states.select(*(F.col(k).alias(f"_{k}") for k in keys), F.explode("cells").alias("_c")).select(*(f"_{k}" for k in keys), "_c.cell", "_c.n")
    one = asked.select(*keys, value).distinct().withColumn("_cell", F.explode(_cells(F.col(value), width, depth)))
    same = F.col("_cell") == F.col("cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    found = one.join(cells, same, "left").groupBy(*keys, value).agg(F.min(F.coalesce("n", F.lit(0))).alias("at_most"))
    return _beside(asked, found, (*keys, value))
