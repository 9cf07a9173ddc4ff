"""WARC archives of pages, read back as one ordered index of all captures.

Writing: a capture whose payload of at least ``least`` bytes is that of a capture with a smaller id becomes a revisit
record, which names that capture and carries no payload; all others are responses. Every task writes archives of its own,
one gzip member a record, under names that no other attempt uses; the list of archives is committed as a table, so what a
lost task left behind is never read. The folder must be one that pyarrow's file systems open (file, hdfs, s3, gs).

Reading: every task reads whole archives and tells its captures as a run, which is sorted by URL key, time, id and digest
as it is written. The runs are cut into ranges of that order, about ``range_rows`` captures each and inside one URL's
history too, and each range's pieces of the runs are merged by a loser tree. Ranges are counted, so places in the whole
order and in each URL's history go on from range to range without any task seeing them all.

The payload's digest and size are those of the bytes read; of a revisit, those that its record states.

Edge cases: a null html is an empty payload; a null URL has the empty key and its record no target; spaces, tabs and line ends in a URL are
escaped. Rows that repeat an id and its payload are responses both or revisits both; a row without id never is the one
that others revisit, unless ids lack throughout, and then all are responses. Payloads hold anything, record ends too, and
any length. An empty table gives no archive and no row. Working columns come from named columns only, so extra columns
can't clash. The table has no capture time: records are dated by id, second by second from 2024 on (an id modulo 10**9).
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import drop, removed, shared_dir, stored, table

START = 1_704_067_200
ESCAPED = (("\t", "%09"), ("\n", "%0A"), ("\r", "%0D"), (" ", "%20"))
CAPTURE = "page_id long, url_key string, captured long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, place long"
ORDER = ("url_key", "captured", "page_id", "payload_digest", "archive", "place")
_CAPITALS = {c: c + 32 for c in range(65, 91)}


def url_key(url: str | None) -> str:
    """The host's labels from the last one on, lower case and without www, then path and query as they are; no fragment."""
    if url is None:
        return ""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url)
    host = re.match(r"[^/?#]*", rest)[0]
    labels = re.sub(r"^www[0-9]*\.", "", host.translate(_CAPITALS)).split(".")
    return f"{','.join(reversed(labels))}){rest[len(host) :].partition('#')[0]}"


def revisits(pages: DataFrame, least: int = 100, salts: int = 16) -> DataFrame:
    """(page_id, digest, first) of the captures that repeat a payload of a smaller id; a payload's copies meet in ``salts`` places."""
    rows = pages.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("size")).where(F.col("size") >= least)
    firsts = rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    side = firsts.select(F.col("digest").alias("_digest"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    both = dealt.join(side, (F.col("digest") == F.col("_digest")) & (F.col("salt") == F.col("_salt")))
    return both.where(~F.col("page_id").eqNullSafe(F.col("first"))).select("page_id", "digest", "first").distinct()


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id} {digest}'.encode(), usedforsecurity=False).digest())}>"


def record(page_id: int | None, url: str | None, captured: int, payload: bytes, first: int | None, digest: str | None = None) -> bytes:
    """One WARC record. Its block is an HTTP response; that of a revisit ends with the head."""
    digest = digest or hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if first is not None else payload)
    head = {"WARC-Type": "response" if first is None else "revisit", "WARC-Record-ID": _record_id(page_id, digest), "WARC-Date": f"{datetime.fromtimestamp(captured, UTC):%Y-%m-%dT%H:%M:%SZ}"}
    if url is not None:
        for a, b in ESCAPED:
            url = url.replace(a, b)
        head["WARC-Target-URI"] = url
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if first is not None:
        head |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _record_id(first, digest), "X-Refers-To-Page-ID": str(first)}
    head |= {"WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def _head(stream) -> dict[str, str]:
    """Header lines up to an empty one."""
    out = {}
    while line := stream.readline().rstrip(b"\r\n"):
        name, _, value = line.decode().partition(": ")
        out[name] = value
    return out


def captures(stream) -> Iterator[tuple]:
    """(page_id, url_key, captured, payload_bytes, payload_digest, record_type, refers_to, place) of each record; place counts records."""
    place = 0
    while stream.readline():
        head = _head(stream)
        block = io.BytesIO(stream.read(int(head["Content-Length"])))
        stream.read(4)
        block.readline()
        http = _head(block)
        number = lambda name, head=head: int(head[name]) if name in head else None
        if head["WARC-Type"] == "response":
            payload = block.read()
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        else:
            size, digest = int(http["Content-Length"]), head["WARC-Payload-Digest"].partition(":")[2]
        captured = int(datetime.strptime(head["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=UTC).timestamp())
        yield number("X-Page-ID"), url_key(head.get("WARC-Target-URI")), captured, size, digest, head["WARC-Type"], number("X-Refers-To-Page-ID"), place
        place += 1


def _opened(path: str):
    return pyarrow.fs.FileSystem.from_uri(path)


def write(pages: DataFrame, folder: str, least: int = 100, archive_bytes: int = 1 << 30) -> DataFrame:
    """(archive, records) of the archives that hold pages (page_id, url, captured, payload), as a committed table."""
    marks = revisits(pages, least).select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), "first")
    rows = pages.withColumn("digest", F.sha2("payload", 256))
    rows = rows.join(marks, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left").select("page_id", "url", "captured", "payload", "digest", "first")

    def run(batches):
        system, path = _opened(folder)
        system.create_dir(path, recursive=True)
        out, name, told = None, "", 0
        for batch in batches:
            for page_id, url, captured, payload, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, told = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                packed = zlib.compressobj(3, wbits=31)
                out.write(packed.compress(record(page_id, url, captured, payload.encode(), first, digest)) + packed.flush())
                told += 1
                if out.tell() >= archive_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([told], pa.int64())})
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "records": pa.array([told], pa.int64())})

    return stored(rows.mapInArrow(run, "archive string, records long"), "warc-archives")


def runs(archives: DataFrame) -> DataFrame:
    """CAPTURE and ``run`` of every record of the archives: what one task reads is one run, in order."""
    schema = pa.schema([("page_id", pa.int64()), ("url_key", pa.string()), ("captured", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("place", pa.int64())])

    def run(batches):
        me = TaskContext.get().partitionId()
        for batch in batches:
            for archive in batch.column("archive").to_pylist():
                system, path = _opened(archive)
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    rows = captures(stream)
                    while some := [r for _, r in zip(range(4096), rows)]:
                        told = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), schema.types, strict=True)], schema=schema)
                        yield pa.RecordBatch.from_arrays([*told.columns[:7], pa.array([archive] * len(some)), told.column(7), pa.array([me] * len(some), pa.int64())], [*schema.names[:7], "archive", "place", "run"])

    n = max(1, min(archives.count(), archives.sparkSession.sparkContext.defaultParallelism * 8))
    found = archives.select("archive").repartition(n, "archive").mapInArrow(run, f"{CAPTURE}, run long")
    return stored(found.sortWithinPartitions(*ORDER), "warc-runs")


def loser_tree(keys: list[list]) -> Iterator[tuple[int, int]]:
    """(run, place) of every key of the sorted runs in order; each step replays one path of the tree of losers."""
    k, at = len(keys), [0] * len(keys)
    head = [(run[0], i) if run else None for i, run in enumerate(keys)]
    losers = [0] * k

    def ahead(a: int, b: int) -> bool:
        return head[b] is None or (head[a] is not None and head[a] < head[b])

    def won(node: int) -> int:
        if node >= k:
            return node - k
        a, b = won(2 * node), won(2 * node + 1)
        first, losers[node] = (a, b) if ahead(a, b) else (b, a)
        return first

    top = won(1) if k > 1 else 0
    while k and head[top] is not None:
        yield top, at[top]
        at[top] += 1
        head[top] = (keys[top][at[top]], top) if at[top] < len(keys[top]) else None
        node = (top + k) // 2
        while node:
            if ahead(losers[node], top):
                top, losers[node] = losers[node], top
            node //= 2


def _merged(batches):
    """One range of the order: its pieces of the runs, merged, with their places in the range and in their URL's share of it."""
    batches = [b for b in batches if len(b)]
    if not batches:
        return
    rows = pa.Table.from_batches(batches)
    names = [n for n in rows.column_names if n != "run"]
    columns = [rows.column(n).to_pylist() for n in ORDER]
    # ids may lack; those without one come first
    keys = [(key, captured, (i is not None, i or 0), *rest) for key, captured, i, *rest in zip(*columns, strict=True)]
    pieces: dict[int, list[int]] = {}
    for place, run in enumerate(rows.column("run").to_pylist()):
        pieces.setdefault(run, []).append(place)
    for own in pieces.values():
        if any(keys[a] > keys[b] for a, b in zip(own, own[1:], strict=False)):  # a run's blocks may arrive in another order
            own.sort(key=keys.__getitem__)
    order_of = list(pieces.values())
    order = [order_of[r][p] for r, p in loser_tree([[keys[i] for i in own] for own in order_of])]
    turn, turns = 0, []
    for a, b in zip([None, *order], order, strict=False):
        turn = turn + 1 if a is not None and keys[a][0] == keys[b][0] else 1
        turns.append(turn)
    out, n = rows.select(names).take(pa.array(order)), len(order)
    more = {"range": pa.array([TaskContext.get().partitionId()] * n, pa.int64()), "step": pa.array(range(1, n + 1), pa.int64()), "turn": pa.array(turns, pa.int64())}
    for name, values in more.items():
        out = out.append_column(name, values)
    yield from out.to_batches()


def history(found: DataFrame, range_rows: int = 250_000) -> DataFrame:
    """CAPTURE, ``position`` in the order of all captures and ``nth`` of its URL's captures, both from 1."""
    parts = -(-found.count() // range_rows)
    cut = found.repartitionByRange(max(parts, found.sparkSession.sparkContext.defaultParallelism), *(F.asc_nulls_first(c) for c in ORDER))
    merged = stored(cut.mapInArrow(_merged, f"{CAPTURE}, range long, step long, turn long"), "warc-history")
    last = F.max_by(F.struct("url_key", "turn"), "step").alias("last")
    ranges = merged.groupBy("range").agg(F.max("step").alias("n"), F.min("url_key").alias("key"), last)  # one row a range from here on
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranges.select("range", F.explode(F.array(F.struct("key", F.lit(0).alias("end"), F.lit(0).cast("long").alias("turns")), F.struct(F.col("last.url_key").alias("key"), F.lit(1).alias("end"), F.col("last.turn").alias("turns")))).alias("e")).select("range", "e.*")
    carried = ends.withColumn("carry", F.coalesce(F.sum("turns").over(Window.partitionBy("key").orderBy("range", "end").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("end = 0")
    starts = ranges.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).join(carried.select("range", "key", "carry"), "range")
    rows = merged.join(starts, "range")
    nth = F.col("turn") + F.when(F.col("url_key") == F.col("key"), F.col("carry")).otherwise(0)
    return rows.select(*(f.split()[0] for f in CAPTURE.split(", ")), (F.col("start") + F.col("step")).alias("position"), nth.alias("nth"))


def dated(page_id: Column) -> Column:
    return START + F.coalesce(F.pmod(page_id, F.lit(10**9)), F.lit(0))


def op12_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", dated(F.col("page_id")).alias("captured"), F.coalesce("html", F.lit("")).alias("payload"))
    folder = f"{shared_dir(spark)}/quarry-warc-{uuid.uuid4().hex}"
    archives = write(pages, folder)
    found = runs(archives)
    removed(spark, folder)  # the index is what the query tells
    drop(archives)
    return history(found).drop("archive", "place")


_ENCODED = "replace(replace(replace(replace(url, chr(9), '%09'), chr(10), '%0A'), chr(13), '%0D'), ' ', '%20')"
OP12_SQL = rf"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, regexp_replace({_ENCODED}, '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest, {START} + coalesce((page_id % 1000000000 + 1000000000) % 1000000000, 0) AS captured FROM pages),
d AS (SELECT page_id, captured, rest, regexp_extract(rest, '^[^/?#]*') AS host, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN rest IS NULL THEN '' ELSE array_to_string(list_reverse(string_split(regexp_replace(translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^www[0-9]*\.', ''), '.')), ',') || ')' || split_part(substr(rest, length(host) + 1), '#', 1) END AS url_key,
  min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM d),
r AS (SELECT *, payload_bytes >= 100 AND first IS NOT NULL AND first IS DISTINCT FROM page_id AS again FROM k)
SELECT page_id, url_key, captured::BIGINT AS captured, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to,
  row_number() OVER (ORDER BY url_key, captured, page_id NULLS FIRST, payload_digest) AS position, row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id NULLS FIRST, payload_digest) AS nth FROM r"""
