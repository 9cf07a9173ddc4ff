"""Joins of curation: ranges, nearest neighbours, guarded zips, updates and work that remains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import first_range


def range_lookup(rows: DataFrame, ranges: DataFrame, at: str, name: str, default=None) -> DataFrame:
    """The first closed range (name, start, end, ord) that holds the value, or the default; see ``intervals.first_range``."""
    return first_range(rows, ranges, at, name, default)


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, reach: int = 3, most: int = 100_000) -> DataFrame:
    """Each left row with the right row nearest in ``at``; ties go to the smaller, nothing beyond ``reach``.

    The right side is first reduced to its distinct places and each place spread over its neighbourhood, the nearest
    one kept of each, so a lookup on equality is left: (at, nearest, distance) for at most 2 * reach + 1 times the places.
    It is broadcast up to ``most`` places and joined by a shuffle beyond.
    """
    places = right.select(F.col(right_at).alias("_place")).where("_place is not null").distinct()
    spread = places.select("_place", F.explode(F.sequence(F.col("_place") - reach, F.col("_place") + reach)).alias("_at"))
    best = spread.groupBy("_at").agg(F.min(F.struct(F.abs(F.col("_place") - F.col("_at")).alias("d"), F.col("_place").alias("p"))).alias("_b"))
    side = best.select("_at", F.col("_b.p").alias("nearest"), F.col("_b.d").alias("distance"))
    side = F.broadcast(side) if places.limit(most + 1).count() <= most else side
    return left.join(side, F.col(at) == F.col("_at"), "left").drop("_at")


def zip_guarded(left: DataFrame, right: DataFrame, key: str, left_order: str, right_order: str) -> tuple[DataFrame, DataFrame]:
    """Rows of each key paired by position where both sides have as many; and (key, left, right, reason) of the others."""
    a = left.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(left_order)))
    b = right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(right_order)))
    sizes = left.groupBy(key).agg(F.count("*").alias("left")).join(right.groupBy(key).agg(F.count("*").alias("right")), key, "full").fillna(0, ["left", "right"])
    skipped = sizes.where("left <> right").withColumn("reason", F.when(F.col("left") == 0, "no markers").otherwise("counts differ"))
    return a.join(b, [key, "_n"]).join(skipped, key, "left_anti").withColumnRenamed("_n", "position"), skipped


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key, by an aggregate."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("_r.*")


def updated(rows: DataFrame, patches: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Columns replaced by non-empty values of the patch with the same key (patches: one row a key)."""
    side = patches.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns))
    out = rows.join(side, F.col(key) == F.col("_key"), "left")
    return out.withColumns({c: F.coalesce(F.nullif(f"_{c}", F.lit("")), c) for c in columns}).select(*rows.columns)


def updated_first(rows: DataFrame, patches: DataFrame, keys: list[str], within: str, order: str, column: str) -> DataFrame:
    """Like ``updated`` for one column, but of the rows with a patch's keys only the first in each group takes it."""
    first = rows.join(patches.select(*keys).distinct(), keys, "left_semi").groupBy(*keys, within).agg(F.min(order).alias("_first"))
    side = first.join(patches.select(*keys, F.col(column).alias("_new")), keys).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(within).alias("_within"), "_first", "_new")
    same = (F.col(order) == F.col("_first")) & F.col(within).eqNullSafe(F.col("_within"))
    for k in keys:
        same = same & (F.col(k) == F.col(f"_{k}"))
    return rows.join(side, same, "left").withColumn(column, F.coalesce("_new", column)).select(*rows.columns)


def positioned(rows: DataFrame, lists: DataFrame, key: str, index: str, values: str, name: str) -> DataFrame:
    """Each row with the value at its 1-based index in its key's list; null where the list is missing or too short."""
    side = lists.select(F.col(key).alias("_key"), F.posexplode(values).alias("_pos", "_value"))
    return rows.join(side, (F.col(key) == F.col("_key")) & (F.col(index) == F.col("_pos") + 1), "left").withColumn(name, F.col("_value")).drop("_key", "_pos", "_value")


def first_existing(wanted: DataFrame, listing: DataFrame, key: str, candidates: str, path: str = "path") -> DataFrame:
    """(key, path) with the first of a row's candidate paths that the listing holds, else null."""
    tried = wanted.select(key, F.posexplode(candidates).alias("_rank", path))
    there = tried.join(listing.select(path).distinct(), path).groupBy(key).agg(F.min_by(path, "_rank").alias(path))
    return wanted.select(key).distinct().join(there, key, "left")


def remaining(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def union_numbered(parts: list[DataFrame], order: str) -> DataFrame:
    """Bag union, left before right, with the source's ordinal beside the order."""
    out = None
    for n, part in enumerate(parts):
        one = part.withColumn("source_ord", F.lit(n))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out
