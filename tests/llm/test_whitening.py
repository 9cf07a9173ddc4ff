"""Whitening against eigenvectors of the exact covariance, on odd vectors, and however the list is dealt out."""

from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest
from conftest import SF, others, rows_of
from quarry.llm import whitening


def by_hand(vectors):
    """{(vec_id, component): ...} for (vec_id, vector); the covariance is exact before it is rounded."""
    kept = [(i, [floor(256 * c) for c in v]) for i, v in vectors if v is not None and all(c is not None and isfinite(c) for c in v)]
    width = max((len(x) for _, x in kept), default=0)
    kept = [(i, x + [0] * (width - len(x))) for i, x in kept]
    distinct = sorted({tuple(x) for _, x in kept})
    n, total = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    if not width:
        return []
    centred = np.array([[n * c - s for c, s in zip(x, total, strict=True)] for x in distinct], object)
    covariance = np.array([[float(Fraction(int(v), n**3)) for v in row] for row in centred.T @ centred])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors.T[::-1]
    out = []
    for i, x in kept:
        off = [n * c - s for c, s in zip(x, total, strict=True)]
        for k in range(min(4, width)):
            e = values[k]
            w = float(np.dot(np.array(off, float) / n, vectors[k]) / np.sqrt(e)) if e > 1e-20 * max(values[0], 0) and e > 1e-12 else None
            square = sum(o * o for o in off)
            out.append((i, k + 1, n, square if square < 1 << 63 else None, w, float(e / values.sum()) if values.sum() > 1e-12 else None))
    return out


def compare(spark, folder, digits=1e-7):
    rows = whitening.op11_whitening(spark, folder).collect()
    want = by_hand(rows_of(folder, "vec_id", "embedding", name="embeddings"))
    key = lambda r: (str(r[0]), r[3] or -1, r[1])
    got = sorted(((r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"]) for r in rows), key=key)
    want.sort(key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for k in {w[1] for w in want}:
        a, b = ([r for r in t if r[1] == k] for t in (got, want))
        assert [r[4] is None for r in a] == [r[4] is None for r in b]
        x, y = (np.array([r[4] or 0.0 for r in t]) for t in (a, b))
        assert min(np.abs(x - y).max(), np.abs(x + y).max()) < digits
        assert all((r[5] is None and s[5] is None) or abs(r[5] - s[5]) < 1e-9 for r, s in zip(a, b, strict=True))
    errors = {r["identity_error"] for r in rows}
    assert len(errors) <= 1 and all(e is None or e < 1e-9 for e in errors)
    return rows


def test_whole_table(spark):
    assert len(compare(spark, SF)) > 0


ODD = [
    (1, [1.0, 2.0, 3.0]), (2, [1.5, -2.0, 0.0]), (3, [0.0, 0.25, 9.0]), (3, [0.0, 0.25, 9.0]), (4, None), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 2.0]), (7, [float("inf"), 1.0, 2.0]),
    (None, [4.0, 4.0, 1.0]), (8, [1.0, 2.0]), (9, []), (10, [-0.0, -0.001, 0.001]), (1, [1.0, 2.0, 3.0]), (11, [1e2, 1e2, -1e2]),
]


@pytest.mark.parametrize("vectors", [ODD, [], [(1, None)], [(1, [])], [(1, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [2.0, 3.0])], [(1, [2.0, 3.0]), (2, [5.0, 3.0])], [(k, [float(k)]) for k in range(9)], [(k % 7, [1.0, 2.0] if k % 3 else [float(k), 0.5]) for k in range(300)]])
def test_odd(spark, tmp_path, vectors):
    others(tmp_path, vectors, [])
    compare(spark, str(tmp_path))


def test_merging_keeps_all(spark):
    """However the list is dealt out, all singular values stay."""
    r = np.random.default_rng(3)
    x = np.unique(r.integers(-500, 500, (900, 12)) * np.arange(1, 13), axis=0)
    whole = whitening.of_batch(x)
    for cuts in ([1, 2, 3], [450], list(range(5, 900, 7))):
        state = None
        for part in np.split(x, cuts):
            one = whitening.of_batch(part)
            state = one if state is None else whitening.merged(state, one)
        assert state.n == len(x) and state.total == x.sum(0).tolist()
        np.testing.assert_allclose(state.singular, whole.singular, rtol=1e-12)
        np.testing.assert_allclose(np.abs((state.vectors * whole.vectors).sum(1)), 1, atol=1e-10)
    frame = spark.createDataFrame([(row.tolist(),) for row in x], "x array<bigint>")
    for parts in (1, 5, 23):
        model = whitening.fit(frame.repartition(parts), fan=3)
        np.testing.assert_allclose(model.values, whole.singular**2 / len(x), rtol=1e-11)


def test_deviation_beyond_a_long_is_null(spark, tmp_path):
    others(tmp_path, [(1, [1e9]), (2, [0.0])], [])
    assert {r["deviation"] for r in whitening.op11_whitening(spark, str(tmp_path)).collect()} == {(256 * 10**9) ** 2 if (256 * 10**9) ** 2 < 1 << 63 else None}
