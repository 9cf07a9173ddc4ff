"""Filter interaction audit: what each filter removes in every order of the filters, told from one CUBE.

Each document fails some of the filters. Documents are counted by part and failure flags, a CUBE over the flags and the
part sums these counts, and its rows whose selected flags are all false hold the survivors of that subset of filters. A
step of an order then is a pair of subsets, joined: those before the filter and those after it.

Texts are read once. Copies are told by SHA-256 of the whole text: counts by (text, part, labels) are made before
anything meets by text, so a text that a third of all rows share sends a few rows. The counts that the CUBE reads are at
most 128 a part, whatever the input; they are cut off as a table.

Edge cases: a null text counts as empty and a null part as the empty string; a row without id fails no copy filter and no
row is its copy, nor is it labelled; rows that repeat an id and text aren't copies of each other (only a smaller id counts);
a document has a label if any of its rows in ``labels`` says so. An empty table gives no part and no row. Texts of any length are read
whole. Only the named columns are read, so extra columns can't clash.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import stored, table

FILTERS = "ABCDE"
_SPACES, _CAPITALS, _MARKS = r"[\x20\x09-\x0D]+", "[^A-Z]+", "[#$%&*|]"


def failures(text: Column) -> dict[str, Column]:
    """Conditions A to D of a text that isn't null, as one struct's fields; words are split once."""
    split = F.filter(F.split(text, _SPACES), lambda w: w != "")
    sizes = lambda w: F.struct(F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct"))
    counted = F.element_at(F.transform(F.array(split), sizes), 1)
    capitals = F.length(F.regexp_replace(text, _CAPITALS, "")).cast("long")
    test = lambda n: {"A": n["words"] < 100, "B": 100 * n["distinct"] < 80 * n["words"], "C": 100 * capitals > 10 * F.length(text), "D": text.rlike(_MARKS)}
    failed = F.element_at(F.transform(F.array(counted), lambda n: F.struct(*(c.alias(k) for k, c in test(n).items()))), 1)
    return {k: failed[k] for k in "ABCD"}


def labelled(labels: DataFrame) -> DataFrame:
    """(labelled, good, toxic) of each labelled id."""
    any_of = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias({"quality": "good"}.get(c, c))
    return labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("labelled")).agg(any_of("quality"), any_of("toxic"))


def cells(documents: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, A to E, good, toxic, n): how many documents of each part fail these filters and bear these labels."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", F.coalesce(part, F.lit("")).alias("part"), F.sha2(text, 256).alias("key"), F.struct(*(c.alias(k) for k, c in failures(text).items())).alias("failed"))
    one = rows.groupBy("doc_id", "part", "key", "failed").agg(F.count("*").alias("n"))
    # rows without an id meet no label; they are spread by their text
    one = one.withColumn("salt", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("key"), F.lit(4096)) + 1).otherwise(0))
    told = one.join(labelled(labels).withColumn("none", F.lit(0).cast("long")), (F.col("doc_id") == F.col("labelled")) & (F.col("salt") == F.col("none")), "left")
    told = told.fillna(False, ["good", "toxic"])
    with_id = F.sum(F.when(F.col("doc_id").isNotNull(), F.col("n")).otherwise(0)).alias("with_id")
    same = told.groupBy("key", "part", "failed", "good", "toxic").agg(F.sum("n").alias("n"), with_id, F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"))
    first = F.col("least") == F.min("least").over(Window.partitionBy("key"))
    copies = same.withColumn("copies", F.col("with_id") - F.when(first, F.col("n_least")).otherwise(0))
    both = F.array(F.struct(F.lit(False).alias("E"), (F.col("n") - F.col("copies")).alias("n")), F.struct(F.lit(True).alias("E"), F.col("copies").alias("n")))
    split = copies.select("part", "failed.*", "good", "toxic", F.explode(both).alias("s")).select("part", *"ABCD", "s.E", "good", "toxic", "s.n")
    counts = split.where("n > 0").groupBy("part", *FILTERS, "good", "toxic").agg(F.sum("n").alias("n"))
    return counts.coalesce(documents.sparkSession.sparkContext.defaultParallelism)  # few rows, so no task for each shuffle partition


def survivors(counts: DataFrame, filters: str = FILTERS, total: bool = False) -> DataFrame:
    """(part, subset, kept, good, toxic) of every subset of the filters, a bit each; zeros included. total: all parts, as part null.

    counts has a row of part, flags, good, toxic and n; a row of count zero without failures puts every subset into the CUBE.
    """
    none = counts.select("part").distinct().select("part", *(F.lit(False).alias(f) for f in (*filters, "good", "toxic")), F.lit(0).cast("long").alias("n"))
    sums = [F.sum("n").alias("kept"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic"))]
    chosen = sum((1 - F.grouping(f).cast("int")) * 2**k for k, f in enumerate(filters))
    cube = counts.select(*none.columns).unionByName(none).cube("part", *filters).agg(*sums, chosen.alias("subset"), F.grouping("part").alias("_all"))
    alive = ~F.greatest(*(F.coalesce(F.col(f), F.lit(False)) for f in filters))
    return cube.where(alive & (F.col("_all") == int(total))).select("part", F.col("subset").cast("int").alias("subset"), "kept", "good", "toxic")


def steps_of(spark, filters: str = FILTERS) -> DataFrame:
    """(filter_order, step, filter, before): every step of every order, k * k! fixed rows for k filters."""
    rows = [("".join(o), k + 1, filters.index(f), sum(2 ** filters.index(g) for g in o[:k])) for o in permutations(filters) for k, f in enumerate(o)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, before int")


def audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row per part, order and step, from ``cells``."""
    k = len(filters)
    alone = stored(survivors(counts, filters), "audit-survivors")  # read from both sides of a pair
    bit = F.element_at(F.array(*(F.lit(2**i) for i in range(k))), F.col("filter") + 1)
    others = F.filter(F.array(*map(F.lit, range(k))), lambda i: F.floor(F.col("subset") / F.pow(F.lit(2), i)) % 2 == 0)
    before = alone.select("part", "subset", *(F.col(c).alias(f"{c}_before") for c in ("kept", "good", "toxic")), F.explode(others).alias("filter")).withColumn("after", F.col("subset") + bit)
    after = alone.withColumnRenamed("subset", "after")
    lost = [(F.col(f"{c}_before") - F.col(c)).alias(name) for c, name in (("kept", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))]
    pairs = before.join(after, ["part", "after"]).select("part", F.col("subset").alias("before"), "filter", "kept", *lost)
    size, own = F.bit_count("before"), Window.partitionBy("part", "filter")
    weight = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k))), size + 1)
    fails = F.max(F.when(F.col("before") == 0, F.col("removed"))).over(own)
    unique = F.max(F.when(size == k - 1, F.col("removed"))).over(own)
    pairs = pairs.withColumns({"fails": fails, "unique_fails": unique, "shapley": F.sum(F.col("removed") * weight).over(own).cast("long")})
    rows = pairs.join(F.broadcast(steps_of(counts.sparkSession, filters)), ["before", "filter"])
    return rows.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def op13_audit(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return audit(stored(cells(documents, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")), "audit-cells"))


#: every order and step counted by itself, without subsets
OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e FROM t),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM f LEFT JOIN l ON f.doc_id = l.doc_id GROUP BY ALL),
v AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM v p, v q, v r, v s, v u WHERE len(list_distinct([p.x, q.x, r.x, s.x, u.x])) = 5),
k AS (SELECT filter_order, step, 2 ** (ascii(filter_order[step]) - 65) AS own, coalesce(list_sum(list_transform(range(1, step), lambda i: 2 ** (ascii(filter_order[i]) - 65))), 0) AS earlier FROM o, (SELECT unnest(range(1, 6)) AS step)),
g AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & own::INT = 0 AND mask & earlier::INT = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own::INT > 0 AND mask & earlier::INT = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & own::INT > 0 AND mask & earlier::INT > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
  coalesce(sum(n) FILTER (good AND mask & own::INT > 0 AND mask & earlier::INT = 0), 0) AS good_lost, coalesce(sum(n) FILTER (toxic AND mask & own::INT > 0 AND mask & earlier::INT = 0), 0) AS toxic_lost FROM m, k GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g"""
