"""MinHash near-duplicates with odd sketches.

A document's set holds its distinct shingles of five words. MinHash samples are cut into bands whose hashes put likely
pairs into buckets. One-permutation MinHash samples are folded into a parity bitmap (odd sketch): the population count of
two bitmaps' XOR estimates their similarity, which orders and prunes a bucket's pairs before the full sets are compared.

* Exact copies of a set are one class from the start; only classes are banded.
* Round 1 asks for the edges of a maximum spanning forest of each bucket (by sketch similarity), so a bucket of n classes
  gives n - 1 pairs. Buckets of more than ``chunk`` classes are split by hash.
* Confirmed links join classes to components. Round 2 asks for every pair (within the sketch's reach) that stands in one
  bucket but in two components, chunk against chunk, so that no link between components is lost.

Links are confirmed on the full sets. Components are found by alternating large-star and small-star steps on tables in
the shared folder. Nothing that grows with the documents reaches the driver.

A class is named by the number of its first row and holds (class, doc_id) rows, so rows that share an id but differ in
text lose no link: their classes are of one component.

Edge cases: a null text or one without words has an empty set and is linked with nothing (its id may stand in a component
over another row); a row without id is a component of its own (component_id null, kept). Repeated rows of one id and text
get the same result. Ties don't arise: the smallest id names a component. An empty table gives an empty result. Only named
columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import drop, stored, table, working_name

WORDS = 5
BANDS, ROWS = 24, 4
SAMPLES = BANDS * ROWS
BINS, BITS = 2048, 4096  # of the one-permutation samples that a sketch folds, and of the sketch
_RNG = np.random.default_rng(20_240_517)
_A = _RNG.integers(1, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_PLACE = _RNG.integers(1, 1 << 62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slice."""
    starts, ends, first = _text.word_bounds(data, offsets, _text.SPACE)
    words = _text.word_hashes(data, starts, ends)
    n = max(len(words) - WORDS + 1, 0)
    joint = np.zeros(n, np.uint64)
    for k in range(WORDS):
        joint += words[k : k + n] * _PLACE[k]
    joint = _text.mix(joint)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            out.append(np.unique(joint[a : b - WORDS + 1]))
        elif b > a:
            whole = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64)
            out.append(_text.mix(np.array([whole + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sample(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """MinHash samples (documents x SAMPLES) for the bands; odd sketches (documents x BITS / 8 bytes) of one-permutation samples, and how many each folds."""
    flat = np.concatenate(sets)
    first = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    low = (flat >> np.uint64(32)).astype(np.uint32)
    samples = np.empty((SAMPLES, len(sets)), np.uint32)
    for k in range(SAMPLES):
        samples[k] = np.minimum.reduceat(low * _A[k] + _B[k], first)
    samples = samples.T.astype(np.uint64)
    # the least hash of each bin is the first one of a sorted set that falls into it
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    slot = row * BINS + (flat >> np.uint64(53)).astype(np.int64)
    least = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    at = row[least] * BITS + (_text.mix(flat[least]) % np.uint64(BITS)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sets) * BITS) & 1).astype(np.uint8).reshape(len(sets), BITS)
    return samples, np.packbits(odd, axis=1), np.bincount(row[least], minlength=len(sets))


def can_link(differing, sizes, filled, percent: int, deviations: float = 5.0):
    """Whether sets with these sizes, samples folded and XOR population count may reach ``percent``: no pair at it is estimated
    lower but by ``deviations`` standard deviations.

    The population count gives the samples that differ, so those that agree; a set pair of similarity j is expected to agree
    in j times the bins that its union fills.
    """
    apart = -BITS / 2 * np.log(np.maximum(1 - 2 * np.asarray(differing, float) / BITS, 1e-9))
    agree = (filled[0] + filled[1] - apart) / 2
    full = lambda n: -BINS * np.expm1(np.asarray(n, float) * np.log1p(-1 / BINS))
    j = percent / 100
    union = (sizes[0] + sizes[1]) / (1 + j)
    bins = full(union) * (filled[0] + filled[1]) / np.maximum(full(sizes[0]) + full(sizes[1]), 1e-9)
    variance = 2 * bins * j * (1 - j) * np.maximum(1 - bins / union, 0) + apart**2 / (2 * BITS) + 1
    return agree >= j * bins - deviations * np.sqrt(variance)


def _sign(batches):
    task, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        n, one, two, bands, sketches, filled = [], [], [], [], [], []
        row = pa.array((task << 40) + done + np.arange(batch.num_rows))
        done += batch.num_rows
        for _, _, data, offsets in _text.slices(batch.column("text")):
            sets = shingle_hashes(data, offsets)
            n += [len(s) for s in sets]
            one += [int(_text.mix(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            two += [int(_text.mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).astype(np.int64)) for s in sets]
            some = [s for s in sets if len(s)]
            keys, odd, folded = iter(()), iter(()), iter(())
            if some:
                samples, bitmaps, n_folded = _sample(some)
                rows = samples.reshape(len(some), BANDS, ROWS)
                key = np.zeros((len(some), BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    key = _text.mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, r])
                keys, odd, folded = iter(key.view(np.int64)), iter(bitmaps), iter(n_folded.tolist())
            for s in sets:
                bands.append(next(keys) if len(s) else np.zeros(0, np.int64))
                sketches.append(next(odd).tobytes() if len(s) else None)
                filled.append(next(folded) if len(s) else 0)
        bounds = pa.array(np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32))
        lists = pa.ListArray.from_arrays(bounds, pa.array(np.concatenate([np.zeros(0, np.int64), *bands])))
        yield pa.RecordBatch.from_arrays([row, batch.column("doc_id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), lists, pa.array(sketches, pa.binary()), pa.array(filled, pa.int32())], ["row", "doc_id", "h", "n_shingles", "one", "two", "bands", "sketch", "filled"])


def _popcount(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _forest(sketch: np.ndarray) -> np.ndarray:
    """Edges of a spanning tree that is the best by sketch similarity (Prim)."""
    n, out = len(sketch), []
    best, parent = _popcount(sketch, sketch[0]), np.zeros(n, np.int64)
    inside = np.zeros(n, bool)
    inside[0] = True
    for _ in range(n - 1):
        k = int(np.where(inside, np.iinfo(np.int64).max, best).argmin())
        out.append((int(parent[k]), k))
        inside[k] = True
        d = _popcount(sketch, sketch[k])
        closer = ~inside & (d < best)
        best[closer], parent[closer] = d[closer], k
    return np.array(out, np.int64).reshape(-1, 2)


def _pairs(percent: int, forest: bool):
    """Batches sorted by (key, part): the pairs of each bucket part that sketches let link. Without forest: all of two components."""

    def run(batches):
        for batch in _closed(batches):
            ids, comp, sketch = batch["id"], batch["component"], batch["sketch"]
            cut = np.flatnonzero(np.concatenate([[True], (batch["key"][1:] != batch["key"][:-1]) | (batch["part"][1:] != batch["part"][:-1])]))
            sizes = np.diff(np.append(cut, len(ids)))
            two = cut[sizes == 2]
            left, right = [two], [two + 1]
            for at, n in zip(cut[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if forest:
                    edges = _forest(sketch[at : at + n]) + at
                    left.append(edges[:, 0])
                    right.append(edges[:, 1])
                else:
                    for k in range(at, at + n - 1):
                        other = np.flatnonzero(comp[k + 1 : at + n] != comp[k]) + k + 1
                        other = other[_close(batch, np.full(len(other), k), other, percent)]
                        left.append(np.full(len(other), k))
                        right.append(other)
            a, b = np.concatenate(left), np.concatenate(right)
            near = (comp[a] != comp[b]) & _close(batch, a, b, percent)
            a, b = a[near], b[near]
            if not forest:  # a pair is told once: by the first bucket that both share, and by one of its parts
                bands, key, p, part = (batch[k] for k in ("bands", "key", "p", "part"))
                first = bands[a, (bands[a] == bands[b]).argmax(axis=1)] == key[a]
                once = first & ((p[a] != p[b]) | (part[a] // 65536 == part[a] % 65536))
                a, b = a[once], b[once]
            a, b = ids[a], ids[b]
            found = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)])[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    return run


def _close(batch, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    n, filled = batch["n_shingles"], batch["filled"]
    return can_link(_popcount(batch["sketch"][a], batch["sketch"][b]), (n[a], n[b]), (filled[a], filled[b]), percent)


def _closed(batches):
    """Regroup sorted batches so that no bucket part is cut; each as numpy columns."""
    waiting = []
    for batch in batches:
        if not batch.num_rows:
            continue
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64).reshape(batch.num_rows, BITS // 64)
        own = {k: batch.column(k).to_numpy() for k in batch.schema.names if k not in ("sketch", "bands")} | {"sketch": sketch}
        if "bands" in batch.schema.names:
            own["bands"] = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        same = (own["key"] == own["key"][-1]) & (own["part"] == own["part"][-1])
        if not same.all():
            at = int(np.flatnonzero(~same)[-1]) + 1
            waiting.append({k: v[:at] for k, v in own.items()})
            yield {k: np.concatenate([w[k] for w in waiting]) for k in own}
            waiting = []
            own = {k: v[at:] for k, v in own.items()}
        elif waiting and (waiting[0]["key"][0] != own["key"][0] or waiting[0]["part"][0] != own["part"][0]):
            yield {k: np.concatenate([w[k] for w in waiting]) for k in own}
            waiting = []
        waiting.append(own)
    if waiting:
        yield {k: np.concatenate([w[k] for w in waiting]) for k in waiting[0]}


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids that have a link (a, b): alternating large-star and small-star steps until nothing changes."""
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
    last = mark(edges)
    while last[0]:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        new = stored(small.distinct(), "edges")
        drop(edges)
        drop(large)
        edges, now = new, mark(new)
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _sets(documents: DataFrame, wanted: DataFrame, broadcast_ids: int) -> DataFrame:
    """(id, sorted shingle hashes as bytes) of the wanted classes (id, doc_id, h: of one text of each); broadcast up to a checked number."""

    def run(batches):
        for batch in batches:
            out = [s.tobytes() for _, _, d, o in _text.slices(batch.column("text")) for s in shingle_hashes(d, o)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "set"])

    side = wanted.select("id", F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    side = F.broadcast(side) if wanted.count() <= broadcast_ids else side
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    texts = texts.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")))
    return texts.select("id", "text").mapInArrow(run, "id long, set binary").dropDuplicates(["id"])


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            good = []
            for one, two in zip(batch.column("one"), batch.column("two"), strict=True):
                a, b = np.frombuffer(one.as_buffer(), np.uint64), np.frombuffer(two.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    return run


def signed(documents: DataFrame) -> DataFrame:
    """A row for each document with a number of its own (row), the hash of its text (h), the fingerprint of its set (one, two), bands and sketch; stored."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return stored(rows.mapInArrow(_sign, "row long, doc_id long, h long, n_shingles long, one long, two long, bands array<long>, sketch binary, filled int"), "signed")


def linked_classes(documents: DataFrame, rows: DataFrame, percent: int, chunk: int, broadcast_ids: int, same: bool) -> tuple[DataFrame, DataFrame]:
    """(one, two, id, doc_id, component) of every class, doc_id its smallest, and the confirmed links (a, b) between class ids.

    rows: signed rows whose sets aren't empty. A class holds all rows of one set, its id is the smallest of their row
    numbers. same: classes that share a doc_id are of one component as well.
    """
    reps = rows.groupBy("one", "two").agg(F.min(F.struct("row", "doc_id", "h")).alias("r"), F.min("doc_id").alias("doc_id"))
    reps = stored(reps.select("one", "two", F.col("r.row").alias("id"), "doc_id", F.col("r.doc_id").alias("_id"), F.col("r.h").alias("h")), "classes")
    members = rows.join(reps.select(F.col("id").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "bands", "sketch", "n_shingles", "filled")
    members = stored(members, "members")
    banded = members.select("id", F.explode("bands").alias("key"))
    sizes = banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    buckets = stored(banded.join(sizes, "key").select("key", "id", F.ceil(F.col("n") / chunk).cast("int").alias("parts")), "buckets")
    sketches = members.select("id", "sketch", "n_shingles", "filled", "bands")
    n_tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def candidates(rows: DataFrame, forest: bool) -> DataFrame:
        dealt = rows.join(sketches.drop("bands") if forest else sketches, "id").repartition(n_tasks, "key", "part").sortWithinPartitions("key", "part", "id")
        return dealt.select("key", "part", "id", "component", "n_shingles", "filled", "sketch", *([] if forest else ["p", "bands"])).mapInArrow(_pairs(percent, forest), "a long, b long").distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        wanted = reps.select("id", F.col("_id").alias("doc_id"), "h").join(ids, "id", "left_semi")
        sets = stored(_sets(documents, wanted, broadcast_ids), "sets")
        one = sets.select(F.col("id").alias("a"), F.col("set").alias("one"))
        two = sets.select(F.col("id").alias("b"), F.col("set").alias("two"))
        out = stored(pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(_confirm(percent), "a long, b long, linked boolean"), "links")
        drop(sets)
        return out

    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    first = stored(candidates(buckets.select("key", part.alias("part"), "id", F.col("id").alias("component")), True), "pairs")
    tested = confirmed(first)
    found = components(tested.where("linked"))
    # buckets that still hold several components: every pair of parts that hold them
    labelled = buckets.join(found, "id", "left").select("key", "id", "parts", F.coalesce("component", "id").alias("component"))
    labelled = stored(labelled, "labelled")
    mixed = labelled.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    open_ = labelled.join(mixed, "key").select("key", "id", "component", "parts", part.alias("p"))
    open_ = open_.select("key", "id", "component", "p", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.greatest(q, F.col("p")) * 65536 + F.least(q, F.col("p")))).alias("part"))
    second = candidates(open_, False).join(tested.select("a", "b"), ["a", "b"], "left_anti")
    second = stored(second, "pairs")
    links, again = tested.where("linked").select("a", "b"), False
    if not second.isEmpty():
        links, again = stored(links.union(confirmed(second).where("linked").select("a", "b")), "links"), True
    joined = links
    if same:
        shared = rows.groupBy("doc_id").agg(F.min(F.struct("one", "two")).alias("low"), F.max(F.struct("one", "two")).alias("high")).where("low <> high").select("doc_id")
        held = rows.select("doc_id", "one", "two").join(shared, "doc_id", "left_semi").join(reps.select("one", "two", "id"), ["one", "two"]).select("doc_id", "id").distinct()
        held = stored(held, "shared")
        if not held.isEmpty():
            least = held.groupBy("doc_id").agg(F.min("id").alias("a"))
            joined, again = links.union(held.join(least, "doc_id").where("a <> id").select("a", F.col("id").alias("b"))), True
    found = components(joined) if again else found
    named = stored(reps.join(found, "id", "left").select("one", "two", "id", "doc_id", F.coalesce("component", "id").alias("component")), "named")
    for done in (first, second, buckets, labelled, members, reps):
        drop(done)
    return named, links


def classes(documents: DataFrame, percent: int = 85, chunk: int = 4096, broadcast_ids: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id, kept) of every document, and the confirmed links (a, b) between classes.

    percent: least 100 * intersection / union of a link. chunk: most classes that one task compares with each other at once.
    """
    rows = signed(documents)
    usable = rows.where("n_shingles > 0 and doc_id is not null")
    named, links = linked_classes(documents, usable, percent, chunk, broadcast_ids, True)
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = named.select("one", "two", "component").join(least, "component").select("one", "two", "component_id")
    linked = usable.select("doc_id", "n_shingles", "one", "two").join(named, ["one", "two"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if not alone.where("doc_id is not null").isEmpty():  # a text without words may share its id with one that is linked
        other = linked.groupBy("doc_id").agg(F.min("component_id").alias("other"))
        alone = alone.join(other, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("other", "component_id").alias("component_id"))
    every = linked.union(alone)
    return every.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")), links


def deduplicated(documents: DataFrame, percent: int = 80, broadcast_ids: int = 1_000_000) -> DataFrame:
    """One document of each group stays, with its columns: that of the smallest id (nulls last), then of the smallest text hash.

    Groups are of texts, whatever their ids: rows that share an id but no words stay both. Of rows equal in id and text one
    stays, which one of them isn't fixed; texts without words all stay.
    """
    id_, h = (working_name(n, documents.columns) for n in ("_id", "_h"))
    rows = signed(documents)
    usable = rows.where("n_shingles > 0")
    named, _ = linked_classes(documents, usable, percent, 4096, broadcast_ids, False)
    member = usable.select("doc_id", "h", "one", "two").join(named.select("one", "two", "component"), ["one", "two"])
    member = stored(member.groupBy("component", "doc_id", "h").agg(F.count("*").alias("n")), "member")
    rank = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "h")
    least = member.groupBy("component").agg(F.min(rank).alias("least"), F.sum("n").alias("rows")).where("rows > 1").drop("rows")
    told = stored(member.join(least, "component").select(F.col("doc_id").alias(id_), F.col("h").alias(h), (rank != F.col("least")).alias("goes"), "n"), "told")
    gone, again = told.where("goes").select(id_, h), told.where("not goes and n > 1").select(id_, h)
    drop(member)
    some = lambda side: F.broadcast(side) if side.count() <= broadcast_ids else side
    the_same = documents["doc_id"].cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(documents["text"]) == F.col(h))
    out = documents.join(some(gone), the_same, "left_anti")
    if again.isEmpty():
        return out
    side = some(again)
    return out.join(side, the_same, "left_anti").unionByName(out.join(side, the_same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op9_neardup(spark, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
u AS (SELECT r, len(w) AS n_words, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT r, n_words, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS g FROM u WINDOW o AS (PARTITION BY r ORDER BY i)),
x0 AS (SELECT DISTINCT r, g FROM v WHERE g IS NOT NULL UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
f AS (SELECT r, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS f FROM x0 GROUP BY r),
s AS (SELECT d.r, doc_id, coalesce(n, 0) AS n, f FROM d LEFT JOIN f USING (r)),
k AS (SELECT f, min(r) AS c, any_value(n) AS n FROM s WHERE n > 0 AND doc_id IS NOT NULL GROUP BY f),
x AS (SELECT c, n, g FROM k JOIN x0 ON x0.r = k.c),
p AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.g = b.g AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
m AS (SELECT s.doc_id, k.c FROM s JOIN k ON s.f = k.f WHERE s.doc_id IS NOT NULL),
e AS (SELECT u.doc_id AS a, v.doc_id AS b FROM p JOIN m u ON u.c = p.a JOIN m v ON v.c = p.b UNION SELECT min(doc_id) OVER (PARTITION BY c), doc_id FROM m),
l AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b),
z(doc_id, c) AS (SELECT DISTINCT doc_id, doc_id FROM s WHERE doc_id IS NOT NULL UNION SELECT z.doc_id, l.b FROM z JOIN l ON z.c = l.a),
t AS (SELECT doc_id, min(c) AS c FROM z GROUP BY doc_id)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, t.c AS component_id, coalesce(s.doc_id = t.c, true) AS kept FROM s LEFT JOIN t ON s.doc_id = t.doc_id
"""
