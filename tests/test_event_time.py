"""Streams of several micro-batches against the batch of the same functions; late rows are dropped and counted."""

import json
import random
import time
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from quarry.streaming import event_time

SCHEMA = "id long, user string, at timestamp"
START = datetime(2024, 1, 1, tzinfo=UTC)


def put(folder, n, rows):
    (folder / f".{n}").write_text("\n".join(json.dumps({"id": i, "user": u, "at": None if s is None else (START + timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ")}) for i, u, s in rows))
    (folder / f".{n}").rename(folder / f"{n:03}.json")


def run(spark, df, tmp_path, feed, name):
    """Each piece of the feed becomes a micro-batch of its own."""
    out = []
    for piece in feed:
        piece()
        q = df.writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        out.append(q)
    return spark.read.parquet(str(tmp_path / f"{name}-out")), out


@pytest.mark.parametrize("kind", ["sliding", "sessions"])
def test_windows_of_a_stream(spark, tmp_path, kind):
    r = random.Random(7)
    folder = tmp_path / "in"
    folder.mkdir()
    rows, n = [], 0
    for batch in range(6):  # each batch lies up to 200 s back, which the delay of 300 s allows
        rows.append([(n + k, r.choice(["a", "b", None]), batch * 600 + r.randint(-200, 590)) for k in range(30)] + [(n + 90, "a", None)])
        n += 100
    late = [(9000, "a", 5), (9001, "b", 10)]  # far behind the watermark by then
    end = [(9999, "end", 50_000)]
    made = {
        "sliding": lambda df, delay: event_time.sliding(df, "at", "5 minutes", "1 minute", ("user",), delay, least=F.min("id")),
        "sessions": lambda df, delay: event_time.sessions(df, "at", "40 seconds", ("user",), delay, least=F.min("id")),
    }[kind]
    listener = event_time.LateRows()
    spark.streams.addListener(listener)
    try:
        stream = made(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(folder)), "300 seconds")
        feed = [lambda k=k, x=x: put(folder, k, x) for k, x in enumerate([*rows, late, end, [(10_000, "end", 99_000)]])]
        got, queries = run(spark, stream, tmp_path, feed, kind)
        until = time.time() + 20
        while time.time() < until and not any(listener.dropped.values()):
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    want = made(spark.createDataFrame([(i, u, None if s is None else START + timedelta(seconds=s)) for x in rows for i, u, s in x], SCHEMA), None)
    told = lambda df: sorted(map(tuple, df.where("user is null or user <> 'end'").collect()), key=str)
    assert told(got) == told(want)
    # a late row is dropped from each of its five sliding windows, or as one session
    assert sum(listener.dropped.values()) >= len(late) and len(listener.dropped) >= 1


def test_stream_stream_join(spark, tmp_path):
    """Inner and outer rows of several micro-batches are those of the batch."""
    r = random.Random(3)
    left, right = tmp_path / "left", tmp_path / "right"
    left.mkdir(), right.mkdir()
    a = [[(b * 100 + k, r.choice(["u", "v", "w", None]), b * 300 + r.randint(0, 290)) for k in range(12)] for b in range(5)]
    c = [[(b * 100 + k, r.choice(["u", "v", None]), b * 300 + r.randint(0, 290)) for k in range(12)] for b in range(5)]
    pair = lambda x, y, d: event_time.joined_within(x, y.select(F.col("id").alias("other"), "user", F.col("at").alias("other_at")), ("user",), "at", "other_at", "30 seconds", "1 minute", "left_outer", d, d)
    read = lambda f: spark.readStream.schema(SCHEMA).json(str(f))
    ends = [[(9000 + k, "end", 20_000 + 9_000 * k)] for k in range(3)]
    feed = [lambda k=k, x=x, y=y: (put(left, k, x), put(right, k, y)) for k, (x, y) in enumerate(zip([*a, *ends], [*c, *[[(i + 500, "none", s) for i, _, s in e] for e in ends]], strict=True))]
    got, _ = run(spark, pair(read(left), read(right), "2 minutes"), tmp_path, feed, "join")
    frame = lambda x: spark.createDataFrame([(i, u, START + timedelta(seconds=s)) for rows in x for i, u, s in rows], SCHEMA)
    want = pair(frame(a), frame(c), None)
    told = lambda df: sorted((str((x["id"], x["user"], x["other"])) for x in df.where("id < 9000").collect()))
    assert told(got) == told(want) and any(x["other"] is None for x in want.collect()) and any(x["other"] is not None for x in want.collect())


def test_only_known_joins(spark):
    df = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="how"):
        event_time.joined_within(df, df, ("user",), "at", "at", "1 second", "1 second", "full")
