"""The stateful queue: tries by timers, a restart between two tries, work that comes again."""

import json
import time
from collections import Counter
from pathlib import Path

import pytest
from quarry.streaming import work_queue

SCHEMA = "page int, index int, crop string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, work_queue.PROVIDER)
    yield spark
    spark.conf.set(key, before)


def client_of(folder):
    """Crops that start with f fail twice, those with x always; every call leaves a file."""

    def client(crop):
        calls = Path(folder)
        (calls / f"{crop}-{time.time_ns()}").touch()
        tried = len(list(calls.glob(f"{crop}-*")))
        if crop.startswith("x") or (crop.startswith("f") and tried < 3):
            raise ValueError(f"no {crop}")
        return f"<{crop}>"

    return client


def put(folder, name, rows):
    (folder / f".{name}").write_text("\n".join(json.dumps(dict(zip(("page", "index", "crop"), r, strict=True))) for r in rows))
    (folder / f".{name}").rename(folder / f"{name}.json")


def wait_for(query, test, seconds=90):
    until = time.time() + seconds
    while not test():
        assert query.isActive, query.exception()
        assert time.time() < until, "it took too long"
        time.sleep(0.3)


def results(spark, out):
    if not Path(out, "_spark_metadata").exists():
        return []
    return [(r["page"], r["index"], r["raw"], r["error"], r["attempts"]) for r in spark.read.schema(work_queue.RESULT).parquet(str(out)).collect()]


def test_restart_between_tries(rocks, tmp_path):
    """A restart in mid-retry loses and repeats nothing."""
    work, calls, out, checkpoint = (tmp_path / n for n in ("work", "calls", "out", "checkpoint"))
    work.mkdir(), calls.mkdir()
    begin = lambda wait: work_queue.start(rocks.readStream.schema(SCHEMA).json(str(work)), client_of(str(calls)), str(out), str(checkpoint), every="200 milliseconds", retries=2, wait=wait)
    put(work, "one", [(1, 1, "a"), (1, 2, "f1"), (2, 1, "x1"), (2, 1, "x1"), (3, 1, None)])
    query = begin(6000)
    wait_for(query, lambda: len(results(rocks, out)) >= 2)  # what succeeds at once, and what can't be sent
    query.stop()
    assert sorted(results(rocks, out), key=str) == [(1, 1, "<a>", None, 1), (3, 1, None, "nothing to send", 1)]
    tried = Counter(p.name.split("-")[0] for p in calls.iterdir())
    assert tried["a"] == 1 and 1 <= tried["f1"] <= 2
    put(work, "two", [(1, 1, "a"), (1, 2, "f1"), (4, 1, "b")])  # known, in mid-retry, new
    query = begin(300)
    wait_for(query, lambda: len(results(rocks, out)) >= 5)
    put(work, "three", [(1, 2, "f1"), (4, 1, "b")])  # done by now
    done = query.lastProgress["batchId"]
    wait_for(query, lambda: query.lastProgress["batchId"] > done + 3)
    query.stop()
    got = results(rocks, out)
    assert sorted(got, key=str) == sorted([(1, 1, "<a>", None, 1), (3, 1, None, "nothing to send", 1), (1, 2, "<f1>", None, 3), (2, 1, None, "no x1", 3), (4, 1, "<b>", None, 1)], key=str)
    assert Counter(p.name.split("-")[0] for p in calls.iterdir()) == {"a": 1, "f1": 3, "x1": 3, "b": 1}


def test_forgotten_after_a_time(rocks, tmp_path):
    """What succeeded is done again once its memory has gone."""
    work, calls, out, checkpoint = (tmp_path / n for n in ("work", "calls", "out", "checkpoint"))
    work.mkdir(), calls.mkdir()
    put(work, "one", [(1, 1, "a")])
    query = work_queue.start(rocks.readStream.schema(SCHEMA).json(str(work)), client_of(str(calls)), str(out), str(checkpoint), every="200 milliseconds", remember=1500)
    wait_for(query, lambda: len(results(rocks, out)) == 1)
    time.sleep(2)
    put(work, "two", [(1, 1, "a")])
    wait_for(query, lambda: len(results(rocks, out)) == 2)
    query.stop()
    assert results(rocks, out) == [(1, 1, "<a>", None, 1)] * 2
