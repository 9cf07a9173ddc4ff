"""Archives: whole payloads come back, the loser tree merges, and the order doesn't hang on how captures are dealt out."""

import gzip
import hashlib
import io
import random

import pytest
from conftest import odd_pages, others, rows_of
from oracle import differ
from pyspark.sql import functions as F
from quarry.llm import warc


@pytest.mark.parametrize("payload", ["", "x", "a\r\n\r\nb\r\n\r\n", "é\x00\U0001f600" * 999, "WARC/1.1\r\nContent-Length: 3\r\n\r\n"])
def test_record_round_trip(payload):
    raw = payload.encode()
    packed = b"".join(gzip.compress(warc.record(i, "http://a.b/ c\nd", 1_700_000_000 + i, raw, first)) for i, first in ((3, None), (4, 3)))
    digest = hashlib.sha256(raw).hexdigest()
    key = "b,a)/%20c%0Ad"
    assert list(warc.captures(gzip.GzipFile(fileobj=io.BytesIO(packed)))) == [(3, key, 1_700_000_003, len(raw), digest, "response", None, 0), (4, key, 1_700_000_004, len(raw), digest, "revisit", 3, 1)]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 64])
def test_loser_tree(k):
    r = random.Random(k)
    runs = [sorted(r.randrange(50) for _ in range(r.choice([0, 1, 30]))) for _ in range(k)]
    told = list(warc.loser_tree(runs))
    assert [runs[a][b] for a, b in told] == sorted(x for run in runs for x in run)
    assert len(set(told)) == sum(map(len, runs)) and all(b < d for (a, b), (c, d) in zip(told, told[1:], strict=False) if a == c and runs[a][b] != runs[c][d])


def test_payloads_come_back(spark, odd, tmp_path):
    """What responses hold is what pages held, byte for byte; archives go on in new files at their size."""
    pages = spark.read.parquet(f"{odd}/pages.parquet").select("page_id", "url", warc.dated(F.col("page_id")).alias("captured"), F.coalesce("html", F.lit("")).alias("payload"))
    archives = [r["archive"] for r in warc.write(pages, f"file://{tmp_path}/out", archive_bytes=500).collect()]
    assert len(archives) > 5
    got = []
    for a in archives:
        stream = gzip.open(a.removeprefix("file://"))
        while stream.readline():
            head = warc._head(stream)
            block = io.BytesIO(stream.read(int(head["Content-Length"])))
            stream.read(4), block.readline(), warc._head(block)
            if head["WARC-Type"] == "response":
                got.append((head.get("X-Page-ID"), block.read().decode()))
    told = warc.runs(spark.createDataFrame([(a,) for a in archives], "archive string")).where("record_type = 'response'").count()
    want = [(None if i is None else str(i), h or "") for i, _, h in rows_of(odd, "page_id", "url", "html", name="pages")]
    assert told == len(got) and not set(got) - set(want)
    assert {h for _, h in got} == {h for _, h in want}


@pytest.mark.parametrize("range_rows", [1, 5, 10_000])
def test_ranges(spark, tmp_path, range_rows):
    """One URL holds a third of all captures; its history goes on over ranges."""
    pages = [(k, "http://hot.example.com/" if k % 3 == 0 else f"http://h{k % 5}.org/{k % 7}", f"{k % 11}" * 120) for k in range(400)] + odd_pages()
    others(tmp_path, [], pages)
    rows = spark.read.parquet(f"{tmp_path}/pages.parquet").select("page_id", "url", warc.dated(F.col("page_id")).alias("captured"), F.coalesce("html", F.lit("")).alias("payload"))
    found = warc.history(warc.runs(warc.write(rows, f"file://{tmp_path}/out")), range_rows).drop("archive", "place")
    assert differ(found, warc.OP12_SQL, _only_pages(tmp_path)) == ([], [])


def _only_pages(folder):
    import shutil

    (folder / "only").mkdir()
    shutil.copy(folder / "pages.parquet", folder / "only")
    return str(folder / "only")


def test_all_without_ids(spark, tmp_path):
    others(tmp_path, [], [(None, "http://a.b", "z" * 200)] * 3)
    assert [(r["record_type"], r["refers_to"]) for r in warc.op12_warc(spark, str(tmp_path)).collect()] == [("response", None)] * 3
