"""Exact removal of repeated byte strings by a sparse suffix sort (deep-shallow sorting).

Every 200-byte string is represented by an anchor: the 50-byte string in it with the smallest hash, the leftmost of
equals. Equal strings have their anchor at the same place, so repeats only need to be looked for among occurrences of
the same anchor, one suffix in about 75.

1. All anchors, with a fingerprint of their surroundings (the 150 bytes before and 200 bytes from the anchor on).
   Surroundings that occur twice are covered as a whole; that settles the inside of all copies by counting.
2. What is left are different surroundings of one anchor: ends of copies. Their bytes are fetched and the suffixes from
   the anchor on, and the reversed bytes before it, are sorted: multikey quicksort on 8-byte words to a shallow depth,
   then blind tries for the groups that still agree. In the intervals of common prefixes, the longest common left side
   of each suffix tells which 200-byte strings around it occur again.
3. Anchors with more than ``most`` different surroundings aren't gathered: each 200-byte string around them becomes a
   row, and Spark counts equal ones.

Texts are UTF-8 bytes. Edge cases: a null text is empty; texts under 200 bytes lose nothing; a text that stands in two
rows (also with the same id) is removed whole if it has 200 bytes. An empty table gives an empty result. Only named
columns are read. Fingerprints have 64 bits beside the anchor's own 64.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import drop, stored, table

LENGTH, ANCHOR = 200, 50
LEFT = LENGTH - ANCHOR
SHALLOW = 64


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values (block prefixes and suffixes)."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    rows = padded.reshape(-1, width)
    forward = np.minimum.accumulate(rows, axis=1).ravel()
    backward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, offsets: np.ndarray):
    """Of a slice: each anchor's document, offset in it, anchor hash and fingerprint of its surroundings."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    running = _text.prefix_hash(data, _text.RAW_BYTE_HASH)
    at = np.arange(len(data) - ANCHOR + 1)
    grams = _text.span_hash(running, at, at + ANCHOR)
    least = window_minima(grams >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64), LENGTH - ANCHOR + 1)
    doc_end = np.repeat(offsets[1:], np.diff(offsets))[: len(least)]
    inside = np.arange(len(least)) + LENGTH <= doc_end
    place = np.unique(least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.searchsorted(offsets, place, "right") - 1
    low, high = np.maximum(offsets[doc], place - LEFT), np.minimum(offsets[doc + 1], place + LENGTH)
    around = _text.mix(_text.span_hash(running, low, high) + (place - low).astype(np.uint64))
    return doc, place - offsets[doc], grams[place], around


def _anchor_rows(batches):
    for batch in batches:
        keys = batch.column("key").to_numpy()
        for i, _, data, offsets in _text.slices(batch.column("text")):
            doc, at, gram, around = anchors(data, offsets)
            columns = [pa.array(keys[i + doc]), pa.array(at, pa.int32()), pa.array(gram.view(np.int64)), pa.array(around.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "at", "gram", "around"])


def _surroundings(batches):
    """The bytes around each open anchor; for hot anchors the hash of each 200-byte string around it."""
    for batch in batches:
        keys, texts, places = batch.column("key").to_pylist(), batch.column("text").to_pylist(), batch.column("open").to_pylist()
        out = {k: [] for k in ("gram", "key", "at", "left", "whole", "bytes")}
        for key, text, own in zip(keys, texts, places, strict=True):
            raw = text.encode()
            running = None
            for p in own:
                at = p["at"]
                low, high = max(0, at - LEFT), min(len(raw), at + LENGTH)
                if not p["hot"]:
                    rows = [(p["gram"], key, at, at - low, p["whole"], raw[low:high])]
                else:
                    if running is None:
                        running = _text.prefix_hash(np.frombuffer(raw, np.uint8), _text.RAW_BYTE_HASH)
                    s = np.arange(low, high - LENGTH + 1)
                    h = _text.span_hash(running, s, s + LENGTH).view(np.int64).tolist()
                    rows = [(g, key, x, 0, p["whole"], None) for g, x in zip(h, s.tolist(), strict=True)]
                for name, values in zip(out, zip(*rows, strict=True), strict=True):
                    out[name] += values
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], list(out))


_OPEN = "gram long, key long, at int, left int, whole boolean, bytes binary"


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differing = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differing.bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], ids: list[int]) -> list[int]:
    """Sort strings with a long common prefix: a trie that stores branching depths only; one comparison per insertion."""
    leaf = lambda i: [-1, [i]]  # noqa: E731  [depth, children by byte] or [-1, equal strings]
    root = leaf(ids[0])
    for i in ids[1:]:
        s, node = strings[i], root
        while node[0] >= 0:  # down by the branching bytes alone, any way where none fits
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        depth = common(s, other)
        if depth == len(s) == len(other):
            node[1].append(i)
            continue
        here, parent, edge = root, None, None
        while 0 <= here[0] < depth:
            parent, edge = here, s[here[0]]
            here = here[1][edge]
        mine = s[depth] if depth < len(s) else -1
        if here[0] == depth:
            here[1][mine] = leaf(i)
            continue
        theirs = other[depth] if depth < len(other) else -1
        fork = [depth, {theirs: here, mine: leaf(i)}]
        if parent is None:
            root = fork
        else:
            parent[1][edge] = fork
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] < 0:
            out += node[1]
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Multikey quicksort by 8-byte words to the shallow depth, then blind tries."""
    out, stack = [], [(list(range(len(strings))), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) == 1:
            out += ids
        elif depth >= shallow:
            out += blind_trie_order(strings, ids)
        else:
            words = {i: strings[i][depth : depth + 8] for i in ids}
            pivot = words[ids[len(ids) // 2]]
            parts = [[i for i in ids if words[i] > pivot], [i for i in ids if words[i] == pivot], [i for i in ids if words[i] < pivot]]
            if len(pivot) < 8:  # these strings end here and are equal
                equal = parts[1]
                stack += [(parts[0], depth)] if parts[0] else []
                stack += [([i], depth) for i in reversed(equal)]
                stack += [(parts[2], depth)] if parts[2] else []
            else:
                stack += [(part, depth + 8 * (n == 1)) for n, part in enumerate(parts) if part]
    return out


def repeats(lefts: list[bytes], rights: list[bytes]) -> list[tuple[int, int, int]]:
    """(string, left, right): the string's bytes from ``left`` before to ``right`` after the anchor also stand around another one.

    lefts are reversed. Only reaches of LENGTH bytes together are told; for each interval of the sorted suffixes' common
    prefixes, its members' longest common left sides are those with their neighbours in the left order.
    """
    order, rank = deep_shallow_order(rights), [0] * len(lefts)
    for r, i in enumerate(deep_shallow_order(lefts)):
        rank[i] = r
    heights = [common(rights[a], rights[b]) for a, b in zip(order, order[1:], strict=False)] + [-1]
    found, stack = [], []
    for k, h in enumerate(heights):
        first = k
        while stack and stack[-1][1] > h:
            first, height = stack.pop()
            if height >= ANCHOR:
                members = sorted(order[first : k + 1], key=rank.__getitem__)
                sides = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:], strict=False)]
                for n, i in enumerate(members):
                    side = max(sides[n - 1] if n else 0, sides[n] if n < len(sides) else 0)
                    if side + height >= LENGTH:
                        found.append((i, side, height))
        if h >= 0 and (not stack or stack[-1][1] < h):
            stack.append((first, h))
    return found


def _repeated(batches):
    """Sorted by anchor: the repeated stretches (key, start, end) around anchors with several surroundings."""
    held: list[tuple] = []

    def solve(group):
        if len(group) < 2:
            return []
        lefts = [b[:left][::-1] for _, _, left, _, b in group]
        rights = [b[left:] for _, _, left, _, b in group]
        if len(group) == 2:
            side, height = common(*lefts), common(*rights)
            found = [(0, side, height), (1, side, height)] if side + height >= LENGTH else []
        else:
            found = repeats(lefts, rights)
        return [(group[i][0], group[i][1] - side, group[i][1] + height) for i, side, height in found if not group[i][3]]

    gram = None
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("gram", "key", "at", "left", "whole", "bytes")]
        for g, *row in zip(*columns, strict=True):
            if g != gram:
                out += solve(held)
                held, gram = [], g
            held.append(tuple(row))
        yield _stretches(out)
    yield _stretches(solve(held))


def _stretches(rows):
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["key", "start", "end"])


def stretches(documents: DataFrame, most: int = 50_000) -> DataFrame:
    """(key, stretches): the repeated stretches (start, end) of each text that has some; documents: key, text."""
    n_tasks = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(documents.mapInArrow(_anchor_rows, "key long, at int, gram long, around long"), "anchors")
    around = stored(found.groupBy("gram", "around").agg(F.count("*").alias("n"), F.min(F.struct("key", "at")).alias("one")), "surroundings")
    copies = around.where("n > 1").select("gram", "around")
    # the whole surroundings of copied anchors; ends beyond the text are cut when they are applied
    whole = found.join(copies, ["gram", "around"], "left_semi").select("key", F.greatest(F.col("at") - LEFT, F.lit(0)).alias("start"), (F.col("at") + LENGTH).alias("end"))
    whole = stored(whole.groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("own")), "whole")  # rows that repeat share their key
    drop(found)
    several = around.groupBy("gram").agg(F.count("*").alias("different")).where("different > 1")
    places = around.join(several, "gram").select("one.key", F.struct("one.at", "gram", (F.col("n") > 1).alias("whole"), (F.col("different") > most).alias("hot")).alias("p"))
    places = stored(places.groupBy("key").agg(F.collect_list("p").alias("open")), "open")
    drop(around)
    opened = stored(documents.join(places, "key").select("key", "text", "open").dropDuplicates(["key"]).mapInArrow(_surroundings, _OPEN), "opened")
    drop(places)
    dealt = opened.where("bytes is not null").repartition(n_tasks, "gram").sortWithinPartitions("gram")
    ends = dealt.select("gram", "key", "at", "left", "whole", "bytes").mapInArrow(_repeated, "key long, start int, end int")
    hot = opened.where("bytes is null").select("gram", "key", "at")
    twice = hot.groupBy("gram").agg(F.count_distinct("key", "at").alias("n")).where("n > 1").select("gram")
    hot = hot.join(twice, "gram", "left_semi").select("key", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))
    edges = ends.unionByName(hot).groupBy("key").agg(F.collect_set(F.struct("start", "end")).alias("own"))
    both = whole.unionByName(edges).groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stretches"))
    return stored(both, "stretches")


def merged(rows, n_bytes: int) -> list[tuple[int, int]]:
    """Maximal runs of the union of stretches, cut to the text; runs that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted((max(0, a), min(n_bytes, b)) for a, b in rows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif b > a:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _cut(batches):
    for batch in batches:
        out = {"n_bytes": [], "spans": [], "kept": []}
        lists = batch.column("stretches")
        for n, text in enumerate(batch.column("text")):
            raw = (text.as_py() or "").encode()
            own = lists[n].values
            runs = merged(zip(own.field("start").to_pylist(), own.field("end").to_pylist(), strict=True), len(raw)) if own is not None else []
            kept, at = [], 0
            for a, b in runs:
                kept.append(raw[at:a])
                at = b
            out["n_bytes"].append(len(raw))
            out["spans"].append([{"start": a, "end": b} for a, b in runs])
            out["kept"].append(b"".join([*kept, raw[at:]]) if runs else raw)
        spans = pa.array(out["spans"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        digests = pa.array([hashlib.sha256(k).hexdigest() for k in out["kept"]], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out["n_bytes"], pa.int64()), spans, digests, pa.array(out["kept"], pa.binary())], ["doc_id", "n_bytes", "removed", "kept_sha256", "kept"])


def without_repeats(documents: DataFrame, most: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, removed (start, end in bytes), kept_sha256 and the kept bytes of every document."""
    rows = documents.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    found = stretches(rows.select("key", "text"), most)
    joined = rows.join(found, "key", "left").select("doc_id", "text", "stretches")
    return joined.mapInArrow(_cut, "doc_id long, n_bytes long, removed array<struct<start:long,end:long>>, kept_sha256 string, kept binary")


def op6_suffixes(spark, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), "kept_sha256")
