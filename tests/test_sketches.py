"""Sketches against exact counts, after merging and with empty groups."""

import math
from collections import Counter

from pyspark.sql import functions as F
from quarry.operators import sketches


def data(spark):
    """Three chapters of two books, one with a third of all rows; a null key, value and number."""
    rows = spark.range(90_000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("chapter"), F.when(F.col("id") % 3 == 2, "two").otherwise("one").alias("book"),
        F.floor(F.pow(F.pmod(F.xxhash64("id"), F.lit(4000)) / 4000.0, 3) * 4000).cast("string").alias("word"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(1_000_003)).alias("size"),
    )
    odd = spark.createDataFrame([(None, "one", None, 5), (None, "one", "w", None), ("none", "two", None, None)], "chapter string, book string, word string, size long")
    return rows.unionByName(odd).cache()


def test_bounds(spark):
    rows = data(spark)
    exact = [tuple(r) for r in rows.collect()]
    states = sketches.sketched(rows, ("book", "chapter"), "word", "size").cache()
    books, whole = sketches.merged(states, ("book",)), sketches.merged(states)
    for df, keys, pick in ((states, ("book", "chapter"), lambda r: (r[1], r[0])), (books, ("book",), lambda r: (r[1],)), (whole, (), lambda r: ())):
        groups = {}
        for r in exact:
            groups.setdefault(pick(r), []).append(r)
        found = {tuple(r[k] for k in keys): r for r in sketches.told(df, keys, (0.1, 0.5, 0.9)).collect()}
        assert set(found) == set(groups)
        for g, own in groups.items():
            words, sizes = [r[2] for r in own if r[2] is not None], sorted(r[3] for r in own if r[3] is not None)
            assert found[g]["n"] == len(own)
            assert abs(found[g]["n_distinct"] - len(set(words))) <= 5 * 1.04 / math.sqrt(2**12) * len(set(words)) + 0.5
            assert (found[g]["quantiles"] is None) == (not sizes)
            for rank, q in zip((0.1, 0.5, 0.9), found[g]["quantiles"] or (), strict=False):
                below = sum(s <= q for s in sizes) / len(sizes)
                assert abs(below - rank) <= 0.03 or len(sizes) < 5
        asked = spark.createDataFrame([(*g, w) for g, own in groups.items() for w in {*[r[2] for r in own][:80], "never"} if w], ", ".join([*(f"{k} string" for k in keys), "word string"]))
        counts = Counter((pick(r), r[2]) for r in exact)
        over = 0
        for r in sketches.frequency(asked, df, keys, "word").collect():
            g = tuple(r[k] for k in keys)
            n = len(groups[g])
            assert r["at_most"] >= counts[g, r["word"]]
            over += r["at_most"] - counts[g, r["word"]] > math.e / 2048 * n
        assert over <= max(1, 0.02 * asked.count())


def test_no_rows(spark):
    rows = data(spark).limit(0)
    assert sketches.sketched(rows, ("book",), "word", "size").collect() == []
    assert [(r["n"], r["n_distinct"], r["quantiles"]) for r in sketches.told(sketches.merged(sketches.sketched(rows, ("book",), "word", "size")), ()).collect()] == [(None, 0, None)]
