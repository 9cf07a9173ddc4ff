"""Labels of one class, one calibration at every sample size, slots in linear time."""

import math
import random
import time

import pytest
from conftest import write
from quarry.llm import pii, toxicity


@pytest.mark.parametrize(("toxic", "want"), [([1] * 6, 1.0), ([0] * 6, 0.0), ([], 0.0)])
def test_labels_of_one_class(spark, tmp_path, toxic, want):
    """Every score is the share of label 1."""
    folder = write(tmp_path, [(k, f"some words {k}", "a") for k in range(40)] + [(99, None, "a")], [(k, 1, t) for k, t in zip(range(40), toxic * 7, strict=False)])
    scores = {r["score"] for r in toxicity.op1_toxicity(spark, folder).collect()}
    assert len(scores) == 1 and abs(scores.pop() - want) < 1e-9


@pytest.mark.parametrize("n", [15, 21, 60])
def test_one_calibration(spark, tmp_path, n):
    """A clean text more or less moves the calibration a little, at twenty texts too."""
    r = random.Random(n)
    word = lambda: f"w{r.randrange(60)}"
    documents = [(k, " ".join([word() for _ in range(80)] + ["foul", "vile"] * (9 if k % 2 == 0 else int(k % 50 == 1)) + [word() for _ in range(20)]), "a") for k in range(4 * n)]
    folder = write(tmp_path, documents, [(k, 1, int(k % 2 == 0)) for k in range(4 * n)])
    frame = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(*frame)
    assert math.isfinite(model.log_k) and -12 < model.log_k < 8
    scores = {r["doc_id"]: r["score"] for r in toxicity.op1_toxicity(spark, folder).collect()}
    assert n < 60 or sum((scores[k] >= 0.5) == (k % 2 == 0) for k in range(4 * n)) >= 0.9 * 4 * n


def every_taken(text, taken, lefts, wanted):
    """The slots that stay, each held against all taken spans."""
    free = pii.slots(text, [], lefts, wanted)
    return [s for s in free if all(y <= s[0] or x >= s[1] or (f and s[0] <= x and y <= s[1] and (x, y) != s) for x, y, f in taken)]


def test_slots_against_all_taken():
    r = random.Random(2)
    for _ in range(200):
        text = " ".join(r.choice(["call", "me", "at", "12", "3456", "x,", "now"]) for _ in range(30))
        taken = [(a, a + r.randint(1, 25), r.random() < 0.5) for a in (r.randrange(len(text)) for _ in range(r.randint(0, 9)))]
        lefts, wanted = frozenset({"me", "at"}), frozenset({"L:call me", "L:me at", "B:at|now", "B:me|at"})
        assert pii.slots(text, taken, lefts, wanted) == every_taken(text, taken, lefts, wanted)


def test_slots_are_linear():
    took = []
    for n in (4_000, 16_000):
        text = "call me 1234 now. " * n
        taken = [(m, m + 4, False) for m in range(8, len(text), 18)]
        began = time.perf_counter()
        assert pii.slots(text, taken, frozenset({"me"}), frozenset({"L:call me"})) == []
        took.append(time.perf_counter() - began)
    assert took[1] < 10 * took[0] + 0.5
