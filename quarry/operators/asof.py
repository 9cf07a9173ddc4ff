"""As-of joins: each row with the last place before it, the first after it, or the nearer one, at any distance.

Both sides' different places are put in one order, cut into ranges of that order and sorted inside each. A range knows the
last place up to each row and the first from it on; what lies beyond its borders comes from the ranges' own first and last
places, a row for each range and key, carried on in range order. No place is spread over its neighbourhood, and one key
may go over many ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import Run

DIRECTIONS = ("backward", "forward", "nearest")


def asof(left: DataFrame, right: DataFrame, at: str, right_at: str, by: tuple[str, ...] = (), columns: tuple[str, ...] = (), order: str | None = None, direction: str = "nearest", exact: bool = True, within=None, run: Run | None = None, parts: int | None = None) -> DataFrame:
    """left with ``place``, ``distance`` and these columns of the right row; null where there is none.

    backward: the greatest right value up to the left one; forward: the least from it on; nearest: the nearer of both,
    the smaller at equal distance. exact: equal values count. within: no further than that. Of the right rows at one place
    the first by ``order`` counts (else the least by ``columns``). Keys ``by`` are equal on both sides, nulls too. A row
    whose value is null finds nothing. Left rows stay as they are. ``run`` keeps the ordered table until it is closed; else it stays.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction is one of {DIRECTIONS}")
    run = run or Run(left.sparkSession)
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(b).alias(k) for b, k in zip(by, keys, strict=True)]
    told = F.struct(F.lit(0).alias("_"), *columns)
    first = F.min_by(told, F.col(order)) if order else F.min(told)
    places = right.where(F.col(right_at).isNotNull()).groupBy(*named, F.col(right_at).alias("_at")).agg(first.alias("_told"))
    places = places.select(*keys, "_at", F.struct("_at", "_told").alias("_place"))
    asks = left.where(F.col(at).isNotNull()).select(*named, F.col(at).alias("_at")).distinct()
    events = asks.withColumn("_ask", F.lit(1)).unionByName(places.withColumn("_ask", F.lit(0)), allowMissingColumns=True)
    cut = events.repartitionByRange(parts, *keys, "_at") if parts else events.repartitionByRange(*keys, "_at")
    settled = run.settled(cut.withColumn("_part", F.spark_partition_id()))  # cut once, as the rows and the borders must agree
    tie = F.col("_ask").asc() if exact else F.col("_ask").desc()
    own, upto = ["_part", *keys], (Window.unboundedPreceding, Window.currentRow)
    last = lambda *o: F.last("_place", ignorenulls=True).over(Window.partitionBy(*own).orderBy(*o).rowsBetween(*upto))
    rows = settled.withColumns({"_below": last(F.col("_at").asc(), tie), "_above": last(F.col("_at").desc(), tie)}).where("_ask = 1")
    # what each range has at its borders: a row a range and key
    known = F.when(F.col("_ask") == 0, F.col("_at"))
    spans = settled.groupBy(*own).agg(F.min_by("_place", known).alias("_least"), F.max_by("_place", known).alias("_most"))
    earlier = lambda c, o: F.last(c, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.select(*(F.col(c).alias(f"_c{c}") for c in own), earlier("_most", F.col("_part").asc()).alias("_before"), earlier("_least", F.col("_part").desc()).alias("_after"))
    same = F.lit(True)
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col(f"_c{c}"))
    found = rows.join(carried, same, "left").select(*keys, "_at", F.coalesce("_below", "_before").alias("_below"), F.coalesce("_above", "_after").alias("_above"))
    below, above = F.col("_below._at"), F.col("_above._at")
    pick = {"backward": F.col("_below"), "forward": F.col("_above"), "nearest": F.when(above.isNull() | (F.col("_at") - below <= above - F.col("_at")), F.col("_below")).otherwise(F.col("_above"))}[direction]
    found = found.select(*keys, "_at", pick.alias("_hit"))
    if within is not None:
        found = found.withColumn("_hit", F.when(F.abs(F.col("_hit._at") - F.col("_at")) <= within, F.col("_hit")))
    match = F.col(at) == F.col("_at")
    for b, k in zip(by, keys, strict=True):
        match = match & F.col(b).eqNullSafe(F.col(k))
    out = left.join(found, match, "left")
    return out.select(*(F.col(c) for c in left.columns), F.col("_hit._at").alias("place"), F.abs(F.col("_hit._at") - F.col("_at")).alias("distance"), *(F.col(f"_hit._told.{c}").alias(c) for c in columns))

