"""Held-out accuracy and properties of the classifiers, the mix, the search and the sketches."""

import random

import numpy as np
import pandas as pd
import pytest
from conftest import SF
from quarry.llm import mixing, neardup, quality, search, suffixes, toxicity

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op1_toxicity, "toxic", 0.9), (quality.op3_quality, "quality", 0.95)])
def test_held_out_accuracy(spark, query, label, least):
    found = query(spark, LARGER).toPandas().merge(pd.read_parquet(f"{LARGER}/labels.parquet"), on="doc_id")
    assert found["score"].between(0, 1).all()
    held = found[found["held_out"]]
    assert len(held) > 50 and (held["predicted"] == held[label]).mean() >= least


@pytest.mark.parametrize("query", [toxicity.op1_toxicity, quality.op3_quality])
def test_held_out_labels_are_not_learned(spark, tmp_path, query):
    """Turning every held-out label changes no score."""
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    import zlib

    held = labels["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)
    labels.loc[held, ["quality", "toxic"]] = 1 - labels.loc[held, ["quality", "toxic"]]
    labels.to_parquet(tmp_path / "labels.parquet")
    docs.to_parquet(tmp_path / "documents.parquet")
    a, b = (query(spark, d).toPandas().sort_values("doc_id")["score"].to_numpy() for d in (SF, str(tmp_path)))
    assert np.allclose(a, b)


def test_maximal_segments():
    """Against the recursive definition: the best segment, then the same left and right of it."""

    def slow(v, a, b):
        best = max(((sum(v[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[2], -best[2] - best[1]
        return [*slow(v, a, i), (i, j), *slow(v, j, b)]

    r = random.Random(1)
    for _ in range(200):
        v = [r.choice((-3, -2, -1, 1, 2, 4)) + r.random() / 100 for _ in range(r.randint(0, 14))]
        assert [(a, b) for a, b, _ in toxicity.maximal_segments(np.array(v))] == slow(v, 0, len(v))


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model = quality.fit_trees(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.95
    one = [model.score(row[None, :])[0] for row in x[:20]]
    assert np.allclose(one, model.score(x[:20]))


def test_mix_meets_its_targets(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    found = mixing.mix(docs, keep=("doc_id", "source")).toPandas()
    assert (found["taken"] <= 2 * found["size"]).all()
    by = found.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert ((by["taken"] - by["target"]).abs() <= 1).all() and (by["target"] <= 2 * by["size"] + 1e-6).all()
    assert abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1
    again = mixing.mix(docs.repartition(7), keep=("doc_id", "source")).toPandas()
    key = ["doc_id", "taken"]
    assert found[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_mix_inverts_demand(spark):
    """The integral of a source's schedule up to a document's position is the demand at its offset."""
    from pyspark.sql import functions as F

    for a, b in mixing.SCHEDULES:
        rows = spark.range(11).select((F.col("id") * 10.0).alias("o"), mixing.position(F.col("id") * 10.0, F.lit(100.0), F.lit(a), F.lit(b)).alias("t")).collect()
        assert all(abs((a * r["t"] + (b - a) * r["t"] ** 2 / 2) / ((a + b) / 2) * 100 - r["o"]) < 1e-6 for r in rows)


def test_block_max_wand_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(30):
        lists, scores = [], {}
        for _ in range(rng.integers(1, 6)):
            docs = np.flatnonzero(rng.random(3000) < rng.choice([0.01, 0.2, 0.6]))
            if not len(docs):
                continue
            impacts = rng.integers(1, 50, len(docs)) / 8
            lists.append((docs, impacts))
            for d, s in zip(docs.tolist(), impacts.tolist(), strict=True):
                scores[d] = scores.get(d, 0.0) + s
        best = sorted(((s, d) for d, s in scores.items() if d != 7), key=lambda x: (-x[0], x[1]))[:10]
        if not lists:
            continue
        term = np.repeat(np.arange(len(lists)), [len(d) for d, _ in lists])
        index = search.Index(term, np.concatenate([d for d, _ in lists]), np.concatenate([i for _, i in lists]), len(lists), 3000)
        assert search.best(index, np.arange(len(lists)), 10, range(7, 8)) == best
        floor = best[len(best) // 2][0] if best else 0.0
        assert search.best(index, np.arange(len(lists)), 10, range(7, 8), floor) == [x for x in best if x[0] > floor]


def test_search_in_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    terms, n, mean = search.collection(docs)
    queries = search.more_like(docs.where("doc_id % 10 = 0"), terms).cache()
    one, many = (sorted(map(tuple, search.top_k(docs, queries, n, mean, block_queries=k).collect())) for k in (50_000, 3))
    assert one == many and one


def test_odd_sketches_keep_links():
    """No pair at the threshold is pruned; far pairs mostly are."""
    rng = np.random.default_rng(9)
    kept = 0
    for n in (40, 400, 4000):
        for _ in range(30):
            base = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            same = round(len(base) * 0.93)
            near = np.unique(np.concatenate([base[:same], rng.integers(0, 1 << 63, len(base) - same, dtype=np.uint64)]))
            far = np.unique(np.concatenate([base[: len(base) // 3], rng.integers(0, 1 << 63, 2 * len(base) // 3, dtype=np.uint64)]))
            _, sketch, filled = neardup._sample([base, near, far])
            apart = lambda k: int(np.bitwise_count(sketch[0] ^ sketch[k]).sum())  # noqa: E731, B023
            assert neardup.can_link(apart(1), (len(base), len(near)), (filled[0], filled[1]), 85)
            kept += bool(neardup.can_link(apart(2), (len(base), len(far)), (filled[0], filled[2]), 85))
    assert kept < 45


def test_deep_shallow_order():
    r = random.Random(2)
    for _ in range(60):
        shared = bytes(r.choice(b"ab") for _ in range(90))
        strings = [shared[: r.randint(0, 90)] + bytes(r.choice(b"ab") for _ in range(r.randint(0, 120))) for _ in range(r.randint(1, 40))]
        strings += [shared + bytes(r.choice(b"ab") for _ in range(r.randint(0, 3))) for _ in range(20)]
        assert [strings[i] for i in suffixes.deep_shallow_order(strings)] == sorted(strings)
