"""Interval, as-of and greedy joins against plain Python, with hot keys, nulls and borders between ranges."""

import random
from bisect import bisect_left, bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F
from quarry.operators import asof, intervals, jumps, sequence

NO_LOOP = ("NestedLoop", "Cartesian")


def plan(df):
    return df._jdf.queryExecution().toString()


def first_by_hand(points, ranges, default):
    out = []
    for p in points:
        hits = sorted((o, n) for n, a, b, o in ranges if p is not None and a is not None and b is not None and a <= p <= b)
        out.append((p, hits[0][1] if hits else default))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [1, 7, 64])
@pytest.mark.parametrize("spread", [40, 5000, 10**12])
def test_first_range(spark, width, spread):
    r = random.Random(spread + width)
    ranges = [(f"n{k}", a, a + r.choice([0, 1, 6, spread // 3, spread]), k % 90) for k in range(120) for a in [r.randint(-spread, spread)]] + [("bad", 5, 4, 0), ("null", None, 9, 0), ("open", 3, None, 0)]
    points = [r.randint(-spread - 9, spread * 2) for _ in range(300)] + [None, 0, 0, 0] + [a for _, a, *_ in ranges] + [b for _, _, b, _ in ranges]
    found = intervals.first_range(spark.createDataFrame([(p, "x") for p in points], "at long, level string"), spark.createDataFrame(ranges, "name string, start long, end long, ord int"), "at", "name", "none", width=width)
    assert sorted(((x["at"], x["name"]) for x in found.collect()), key=str) == first_by_hand(points, ranges, "none")
    assert found.columns == ["at", "level", "name"]


def test_no_ranges(spark):
    none = spark.createDataFrame([], "name string, start int, end int, ord int")
    found = intervals.first_range(spark.createDataFrame([(1,), (None,)], "at int"), none, "at", "name", "d")
    assert {tuple(x) for x in found.collect()} == {(1, "d"), (None, "d")}
    assert intervals.first_range(spark.createDataFrame([], "at int"), none, "at", "name").collect() == []


def test_million_overlapping_ranges(spark):
    """All ranges hold the middle, where a third of all rows stand."""
    n, middle = 1_000_000, 10_000_000
    ranges = spark.range(n).select(F.concat(F.lit("r"), "id").alias("name"), (middle - 1 - F.col("id") * 7).alias("start"), (middle + 1 + (n - F.col("id")) * 3).alias("end"), F.col("id").alias("ord"))
    rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, middle).otherwise(F.col("id") * 67).alias("at"))
    found = intervals.first_range(rows, ranges, "at", "name", "none")
    assert not any(x in plan(found) for x in NO_LOOP)
    got = found.groupBy("at", "name").count().toPandas()
    # the first range that holds a value: the least id that reaches down, if it still reaches up
    at = got["at"].to_numpy()
    least = np.maximum(0, -((at - (middle - 1)) // 7))
    holds = (least < n) & (at <= middle + 1 + (n - least) * 3)
    assert (got["name"] == np.where(holds, np.char.add("r", least.astype(str)), "none")).all()
    assert got.loc[got["at"] == middle, "count"].sum() >= 66_667 and got["count"].sum() == 200_000


@pytest.mark.parametrize("width", [1, 10])
def test_holding(spark, width):
    r = random.Random(width)
    ranges = [(k, a, a + r.randint(0, 50)) for k in range(60) for a in [r.randint(-99, 99)]]
    points = [r.randint(-120, 170) for _ in range(90)] + [None]
    found = intervals.holding(spark.createDataFrame([(p,) for p in points], "at int"), spark.createDataFrame(ranges, "rid int, start int, end int"), "at", ("rid",), width)
    assert sorted(map(tuple, found.collect())) == sorted((p, k) for p in points if p is not None for k, a, b in ranges if a <= p <= b)
    assert not any(x in plan(found) for x in NO_LOOP)


def neighbour(values, v, direction, exact):
    below = bisect_right(values, v) if exact else bisect_left(values, v)
    above = bisect_left(values, v) if exact else bisect_right(values, v)
    low, high = values[below - 1] if below else None, values[above] if above < len(values) else None
    if direction == "backward":
        return low
    if direction == "forward":
        return high
    return high if low is None else low if high is None or v - low <= high - v else high


@pytest.mark.parametrize("direction", asof.DIRECTIONS)
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("parts", [1, 9])
def test_asof(spark, direction, exact, parts):
    """Two thirds of all rows have one key, which goes over several ranges; distances have no bound."""
    r = random.Random(parts)
    key = lambda k: None if k % 11 == 0 else "hot" if k % 3 else f"k{k % 5}"
    left = [(key(k), r.choice([None, r.randint(-50, 50), 10**9, -(10**9)]) if k % 9 == 0 else r.randint(0, 4000)) for k in range(600)] + [("alone", 5), ("hot", 77), ("hot", 77)]
    right = [(key(k), r.randint(0, 4000), k) for k in range(300)] + [("hot", None, 0), ("other", 3, 1)]
    a, b = spark.createDataFrame(left, "g string, at long"), spark.createDataFrame(right, "g string, spot long, n long")
    found = asof.asof(a, b, "at", "spot", ("g",), ("n",), "n", direction, exact, parts=parts)
    want = []
    for g, v in left:
        own = sorted({s for h, s, _ in right if h == g and s is not None})
        p = None if v is None else neighbour(own, v, direction, exact)
        want.append((g, v, p, None if p is None else abs(p - v), None if p is None else min(n for h, s, n in right if h == g and s == p)))
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert not any(x in plan(found) for x in (*NO_LOOP, "Generate"))


def test_asof_without_keys_and_within(spark):
    a, b = spark.createDataFrame([(1.5,), (9.0,), (None,), (-99.0,)], "at double"), spark.createDataFrame([(2.0,), (7.0,), (11.0,)], "spot double")
    got = {r["at"]: (r["place"], r["distance"]) for r in asof.asof(a, b, "at", "spot", within=3).collect()}
    assert got == {1.5: (2.0, 0.5), 9.0: (7.0, 2.0), None: (None, None), -99.0: (None, None)}
    assert {r["place"] for r in asof.asof(a, b.limit(0), "at", "spot").collect()} == {None}
    assert asof.asof(a.limit(0), b, "at", "spot").collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_greedy_like_arrays(spark, seed):
    r = random.Random(seed)
    boxes = [(r.choice(["a", "b", None]), r.randint(0, 900 + 4000 * seed), r.randint(1, 60)) for _ in range(200)] + [("one", 4, 4), ("same", 7, 9), ("same", 7, 9), ("null", None, 3)]
    df = spark.createDataFrame(boxes, "g string, y long, h long")
    arrays = df.where("y is not null").groupBy("g").agg(F.collect_list(F.struct("y", "h")).alias("b"), F.collect_list("y").alias("v"))
    kept = {(x["g"], y) for x in arrays.select("g", F.transform(sequence.thinned(F.col("b")), lambda b: b["y"]).alias("k")).collect() for y in x["k"]}
    assert {tuple(x) for x in jumps.thinned(df, ("g",)).collect()} == kept
    starts = {(x["g"], y) for x in arrays.select("g", sequence.cluster_starts(F.col("v")).alias("k")).collect() for y in x["k"]}
    got = jumps.clustered(df, ("g",), "y").collect()
    assert {(x["g"], x["start"]) for x in got if x["y"] is not None} == starts and len(got) == len(boxes)
    assert all(0 <= x["y"] - x["start"] <= 60 for x in got if x["y"] is not None) and [x["start"] for x in got if x["y"] is None] == [None]


def test_one_long_group(spark):
    """A million values of one group, over all tasks."""
    df = spark.range(1_000_000).select((F.col("id") * 3).alias("y"), F.lit(2).alias("h"))
    got = [x["y"] for x in jumps.thinned(df, (), gap=996).orderBy("y").collect()]
    assert got == list(range(0, 3_000_000, 999))


def test_nothing_to_choose(spark):
    assert jumps.thinned(spark.createDataFrame([], "y long, h long"), ()).collect() == []


@pytest.mark.parametrize("bits", [1, 3, 5])
def test_greedy_over_many_blocks(spark, monkeypatch, bits):
    """Groups that end in a block, begin in it, or go over many, and reaches that go over whole blocks."""
    monkeypatch.setattr(jumps, "BITS", bits)
    r = random.Random(bits)
    rows = [(r.choice(["a", "b", "c", None]), r.randint(0, 3000), r.choice([1, 5, 60, 700])) for _ in range(300)] + [(f"one{k}", k, 1) for k in range(20)]
    df = spark.createDataFrame(rows, "g string, y long, h long")
    for exact in (True, False):
        want = set()
        for g in {x[0] for x in rows}:
            least = {}
            for k, y, h in rows:
                if k == g:
                    least[y] = min(least.get(y, 10**9), y + h)
            at = min(least)
            while at is not None:
                want.add((g, at))
                at = min((y for y in least if (y >= least[at] if exact else y > least[at])), default=None)
        assert sorted(map(tuple, jumps.chosen(df, ("g",), "y", F.col("y") + F.col("h"), exact).collect()), key=str) == sorted(want, key=str)


def test_rounds_join_reaches_only(spark, monkeypatch):
    """No table that is joined to itself has a row for each value."""
    sizes, own = [], jumps.Run.settled
    monkeypatch.setattr(jumps.Run, "settled", lambda self, df: (lambda out: (sizes.append(out.count()) if "_from" in out.columns else None, out)[1])(own(self, df)))
    df = spark.range(400_000).select((F.col("id") * 3).alias("y"), F.lit(2).alias("h"))
    assert jumps.thinned(df, (), gap=996).count() == 1202 and sizes and max(sizes) < 4000
