"""Mixing sources to target weights by a time-varying curriculum.

Each source's target is a share of the budget by weight, stopped at ``repeats`` times the source's size (water-filling).
A source's weight changes over training time from ``a`` to ``b`` (linear schedule). Its integral is the cumulative
demand for the source's words; inverting it at a document's cumulative offset gives the document's training position,
and a range sort by position gives the training order. A source's order is by md5 of the id, so reruns agree.

Offsets are running sums in two levels: over buckets of the md5 (4096 of each source), then inside a bucket, so a
source that holds a third of all rows is spread over as many tasks.

Edge cases: a null or empty text has size 0 and nothing is taken of it; null sources form one source, sorted last; a
null id sorts first in its source. Repeated rows count each for itself. An empty table gives an empty result. Working
columns have names of their own, so extra columns can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import table, working_name

WEIGHTS = (5, 2, 1)
#: start and end rate of a source's weight, repeating over the sources: early, even and late sources
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; each word becomes one letter (regexp_count copies the text for every match)."""
    letters = F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")
    return F.coalesce(F.length(letters), F.lit(0)).cast("long")


def _cycle(values, rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int"))


def targets(sized: DataFrame, share: float = 1.5, repeats: int = 2, weights=WEIGHTS, schedules=SCHEDULES) -> DataFrame:
    """_source, source_size, target, _a, _b: one row per source. The windows run over sources, not documents."""
    by_rank = Window.orderBy(F.col("_source").asc_nulls_last())
    own = sized.groupBy("_source").agg(F.sum("_size").alias("source_size")).withColumn("_rank", F.row_number().over(by_rank) - 1)
    own = own.withColumn("_w", _cycle(weights, F.col("_rank"))).withColumn("_cap", repeats * F.col("source_size"))
    by_room = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    everything = Window.partitionBy()
    own = own.withColumn("_capped", F.coalesce(F.sum("_cap").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = own.withColumn("_open", F.sum("_w").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    own = own.withColumn("_level", (share * F.sum("source_size").over(everything) - F.col("_capped")) / F.col("_open"))
    # the first level that its own source and all after it can take is the one that holds for the open sources
    level = F.min(F.struct("_rank_room", F.col("_level").alias("level"))).over(everything)["level"]
    own = own.withColumn("_rank_room", F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.row_number().over(by_room)).otherwise(F.lit(2**31 - 1)))
    own = own.withColumn("target", F.least(F.col("_cap").cast("double"), F.col("_w") * level))
    return own.select("_source", "source_size", "target", _cycle([a for a, _ in schedules], F.col("_rank")).alias("_a"), _cycle([b for _, b in schedules], F.col("_rank")).alias("_b"))


def position(offset: Column, target: Column, a: Column, b: Column) -> Column:
    """Training time (0 to 1) at which the demand of a source with weight a + (b - a) t reaches the offset."""
    x = F.when(target > 0, offset / target).otherwise(F.lit(1.0))
    return (a + b) * x / (a + F.sqrt(F.greatest(a * a + (b * b - a * a) * x, F.lit(0.0))))


def made_name(name: str, keep) -> str:
    """The name of a new column beside the kept ones."""
    return made_name(f"{name}_mix", keep) if name.lower() in {k.lower() for k in keep} else name


def mix(documents: DataFrame, share: float = 1.5, repeats: int = 2, weights=WEIGHTS, schedules=SCHEDULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per document: the kept columns, size, source_size, target, taken and its training positions (one per pass).

    ``taken`` counts words; each pass over a source takes whole documents but for the one at which its target is reached.
    """
    order = F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))
    sized = documents.select(F.struct(*keep).alias("_kept"), F.col("doc_id").alias("_id"), F.col("source").alias("_source"), order.alias("_order"), n_words(F.col("text")).alias("_size"))
    sized = sized.withColumn("_bucket", F.substring("_order", 1, 3))
    slim = documents.select(F.col("source").alias("_source"), F.substring(order, 1, 3).alias("_bucket"), n_words(F.col("text")).alias("_size"))
    buckets = slim.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_size"))
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    goals = targets(buckets, share, repeats, weights, schedules).withColumnRenamed("_source", "_s")
    offsets = offsets.join(goals, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s").withColumnsRenamed({"_source": "_s", "_bucket": "_k"})
    rows = sized.join(offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_k")))
    inside = Window.partitionBy("_source", "_bucket").orderBy("_order", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_at", F.col("_before") + F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    reach = lambda n: F.floor(F.least(F.col("target"), n.cast("double")))
    passes = [F.col("_at") + k * F.col("source_size") for k in range(repeats)]
    words = [reach(at + F.col("_size")) - reach(at) for at in passes]
    taken = sum(words[1:], words[0])
    places = F.filter(F.array(*(F.when(n > 0, position(at, F.col("target"), F.col("_a"), F.col("_b"))) for at, n in zip(passes, words, strict=True))), lambda x: x.isNotNull())
    made = {"size": F.col("_size"), "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken.cast("long"), "positions": places}
    return rows.select("_kept.*", *(c.alias(made_name(n, keep)) for n, c in made.items()))


def arranged(mixed: DataFrame, positions: str = "positions") -> DataFrame:
    """The documents in training order: range-sorted by their first position; those that aren't taken come last."""
    first = F.coalesce(F.try_element_at(positions, F.lit(1)), F.lit(2.0))
    n = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place, tie = working_name("_first", mixed.columns), working_name("_tie", mixed.columns)
    rows = mixed.withColumn(place, first).withColumn(tie, F.xxhash64(*mixed.columns))  # spreads those of equal position
    return rows.repartitionByRange(n, place, tie).sortWithinPartitions(place, tie).drop(place, tie)


def training_order(documents: DataFrame) -> DataFrame:
    """The documents that the mix takes, with their columns, the mix's columns and in training order."""
    columns = tuple(documents.columns)
    mixed = mix(documents, keep=columns)
    return arranged(mixed.where(F.col(made_name("taken", columns)) > 0), made_name("positions", columns))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    first = F.round(F.try_element_at("positions", F.lit(1)), 6).alias("position")
    return arranged(mix(documents)).select("doc_id", "size", "source_size", "target", "taken", first)


OP4_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS o,
                  CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][CAST(r % 3 AS INT) + 1] AS w, 2 * source_size AS cap FROM s),
l AS (SELECT *, CAST(coalesce(sum(cap) OVER (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS capped,
             CAST(sum(w) OVER (ORDER BY cap / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS room,
             row_number() OVER (ORDER BY cap / w, r) AS k, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM w),
v AS (SELECT *, (CAST(1.5 AS DOUBLE) * total - capped) / room AS level FROM l),
t AS (SELECT source, source_size, [1.5, 1.0, 0.5][CAST(r % 3 AS INT) + 1]::DOUBLE AS a, [0.5, 1.0, 1.5][CAST(r % 3 AS INT) + 1]::DOUBLE AS b, least(CAST(cap AS DOUBLE), w * (SELECT arg_min(level, k) FROM v WHERE level * w <= cap)) AS target FROM v),
p AS (SELECT doc_id, size, source_size, target, a, b,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS c
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
n AS (SELECT *, CAST(floor(least(target, c + size)) - floor(least(target, c)) AS BIGINT) AS once, CAST(floor(least(target, c + source_size + size)) - floor(least(target, c + source_size)) AS BIGINT) AS again FROM p),
x AS (SELECT *, CASE WHEN once > 0 THEN c / target WHEN again > 0 THEN (c + source_size) / target END AS x FROM n)
SELECT doc_id, size, source_size, target, once + again AS taken, round((a + b) * x / (a + sqrt(greatest(a * a + (b * b - a * a) * x, 0.0))), 6) AS position
FROM x
"""
