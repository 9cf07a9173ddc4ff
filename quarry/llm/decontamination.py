"""Benchmark decontamination with a distributed positional inverted index.

1. ``index``: each document's postings (position and term) of all words that occur in the benchmark, stored as a table.
2. The corpus frequency of each term, counted over that table, orders every benchmark window's terms from the rarest.
3. ``matches``: the rarest term's postings, shifted by the term's offset in the window, are intersected with the shifted
   lists of the next rarer terms until all terms agree (exact phrases); with ``slop`` a window is also reported where at
   least ``least`` of its terms stand within that many words of their place (proximity).

The benchmark is taken in blocks of at most ``block_words`` words (or one longer item), so what is sent to executors is
bounded; a further block is a further pass over the index. Postings are sharded by document, so common terms spread over
all tasks and no list is ever gathered.

Edge cases: a null or empty text has no words and no hits; benchmark items without words or without id are left out;
rows of one item_id form one item; repeated documents are judged row by row. Only named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import stored, table, working_name

WINDOW = 13
_SPAN = pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
_SPANS = "array<struct<item_id:string,start:int,end:int>>"
_NEARS = "array<struct<item_id:string,start:int,terms:int>>"
_NEAR = pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("terms", pa.int32())])


class Block:
    """The windows of some benchmark items over a vocabulary of word hashes."""

    def __init__(self, items: list[tuple[str, np.ndarray]]):
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64)] + [w for _, w in items]))
        self.items = sorted({i for i, _ in items})
        at, windows, owner = {x: k for k, x in enumerate(self.items)}, [], []
        for item, words in items:
            own = np.searchsorted(self.vocabulary, words)
            n = min(WINDOW, len(own))
            for row in np.unique(np.lib.stride_tricks.sliding_window_view(own, n), axis=0):
                windows.append(np.pad(row, (0, WINDOW - n), constant_values=-1))
                owner.append(at[item])
        self.windows = np.array(windows, np.int64).reshape(-1, WINDOW)
        self.owner = np.array(owner, np.int64)
        self.length = (self.windows >= 0).sum(1)

    def ordered(self, frequency: np.ndarray) -> np.ndarray:
        """Offsets of each window's terms, the rarest first; padding last."""
        cost = np.where(self.windows >= 0, frequency[self.windows], np.iinfo(np.int64).max)
        return np.argsort(cost, axis=1, kind="stable")


def blocks(benchmark: DataFrame, block_words: int):
    items, n = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("item_id is not null and text is not null")
    for row in rows.toLocalIterator():
        data, offsets = np.frombuffer(row["text"].encode(), np.uint8), np.array([0, len(row["text"].encode())])
        starts, ends, _ = _text.word_bounds(data, offsets, _text.ALNUM)
        if not len(starts):
            continue
        if items and n + len(starts) > block_words:
            yield Block(items)
            items, n = [], 0
        items.append((row["item_id"], _text.word_hashes(data, starts, ends)))
        n += len(starts)
    if items:
        yield Block(items)


def index(documents: DataFrame, vocabulary: np.ndarray, kept: list[str]) -> DataFrame:
    """The kept columns, n_words, and the positions and terms of the words in the vocabulary, for each document."""
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        for batch in batches:
            n_words, sizes, at, terms = [], [], [], []
            for _, _, data, offsets in _text.slices(batch.column("text")):
                starts, ends, first = _text.word_bounds(data, offsets, _text.ALNUM)
                term = _text.lookup(sent.value, _text.word_hashes(data, starts, ends))
                hit = np.flatnonzero(term >= 0)
                words = np.diff(first)
                n_words.append(words)
                sizes.append(np.diff(np.searchsorted(hit, first)))
                at.append((hit - np.repeat(first[:-1], np.diff(np.searchsorted(hit, first)))).astype(np.int32))
                terms.append(term[hit].astype(np.int32))
            join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
            bounds = pa.array(np.concatenate([[0], np.cumsum(join(sizes, np.int64))]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(bounds, pa.array(join(x, np.int32))) for x in (at, terms)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(join(n_words, np.int64)), *lists], [*kept, "n_words", "at", "term"])

    schema = documents.select(*kept).withColumn("n_words", F.lit(0).cast("long")).withColumn("at", F.array(F.lit(0))).withColumn("term", F.array(F.lit(0))).schema
    return documents.select(*dict.fromkeys((*kept, "text"))).mapInArrow(run, schema)


def _intersect(block: Block, order: np.ndarray, place: np.ndarray, term: np.ndarray, slop: int, least: int):
    """(window, start) of all exact matches, and (window, start, terms) of near ones, in one shard's postings."""
    by_term = np.lexsort((place, term))
    lists = term[by_term].astype(np.int64) << 44 | place[by_term]  # sorted by term, then place
    rows, used = np.arange(len(block.windows)), block.length
    anchor = block.windows[rows, order[:, 0]]
    low, high = np.searchsorted(lists, anchor << 44), np.searchsorted(lists, anchor + 1 << 44)
    window = np.repeat(rows, high - low)
    begin = np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low)
    start = (lists[begin + np.arange(len(window))] & (1 << 44) - 1) - order[window, 0]
    good = np.ones(len(window), bool)
    near_window, near_start = window, start
    for k in range(1, WINDOW):
        if not len(window):
            break
        offset = order[window, k]
        want = block.windows[window, offset]
        good = (used[window] <= k) | (_text.lookup(lists, want << 44 | np.maximum(start + offset, 0)) >= 0)
        window, start = window[good], start[good]
    if not slop:
        return window, start, None
    count = np.zeros(len(near_window), np.int64)
    for k in range(WINDOW):
        want = block.windows[near_window, k]
        low = np.searchsorted(lists, np.maximum(want, 0) << 44 | np.maximum(near_start + k - slop, 0))
        high = np.searchsorted(lists, np.maximum(want, 0) << 44 | np.maximum(near_start + k + slop + 1, 0))
        count += (want >= 0) & (high > low)
    close = count >= np.minimum(least, used[near_window])
    return window, start, (near_window[close], near_start[close], count[close])


def _found(postings: DataFrame, block: Block, order: np.ndarray, kept: list[str], slop: int, least: int) -> DataFrame:
    spark = postings.sparkSession
    sent = spark.sparkContext.broadcast((block, order))

    def run(batches):
        block, order = sent.value
        for batch in batches:
            lists = batch.column("at")
            bounds = lists.offsets.to_numpy()
            at, term = lists.values.to_numpy()[bounds[0] : bounds[-1]], batch.column("term").values.to_numpy()[bounds[0] : bounds[-1]]
            row = np.repeat(np.arange(len(lists)), np.diff(bounds))
            # documents follow one another with a gap that no window bridges
            zero = np.concatenate([[0], np.cumsum(batch.column("n_words").to_numpy() + 2 * WINDOW + 2 * slop)]).astype(np.int64) + WINDOW + slop
            window, start, near = _intersect(block, order, zero[row] + at, term.astype(np.int64), slop, least)

            def listed(window, start, third, kind):
                doc = np.searchsorted(zero, start, "right") - 1
                far = (doc >= 0) & (doc < len(lists))
                doc, window, start, third = doc[far], window[far], (start - zero[np.maximum(doc, 0)])[far], third[far]
                by = np.lexsort((third, start, block.owner[window], doc))
                doc, window, start, third = doc[by], window[by], start[by], third[by]
                names = pa.array(block.items, pa.string()).take(pa.array(block.owner[window]))
                values = pa.StructArray.from_arrays([names, pa.array(start, pa.int32()), pa.array(third, pa.int32())], fields=list(kind))
                return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(lists) + 1)), pa.int32()), values)

            local = start - zero[np.maximum(np.searchsorted(zero, start, "right") - 1, 0)]
            columns = [listed(window, start, local + block.length[window], _SPAN)]
            if near is not None:
                columns.append(listed(*near, _NEAR))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), batch.column("n_words"), *columns], [*kept, "n_words", "_spans", *["_near"][: near is not None]])

    schema = postings.select(*kept, "n_words", F.lit(None).cast(_SPANS).alias("_spans"))
    if slop:
        schema = schema.withColumn("_near", F.lit(None).cast(_NEARS))
    return postings.mapInArrow(run, schema.schema)


def matches(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), block_words: int = 2_000_000, slop: int = 0, least: int = 11) -> DataFrame:
    """The kept columns, n_words, spans (item_id, first word, end word) of all exact window matches; with slop also the near ones."""
    kept = [f"_k{i}" for i in range(len(keep))]
    found = {"spans": _SPANS} | ({"near": _NEARS} if slop else {})
    rows = documents.select(*(F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)), "text", *(F.array().cast(kind).alias(c) for c, kind in found.items()))
    coming = blocks(benchmark, block_words)
    block = next(coming, None)
    if block is None:
        rows = index(rows, np.zeros(0, np.uint64), [*kept, *found]).drop("at", "term")
    while block is not None:
        after = next(coming, None)  # the texts are carried only as long as a further block needs them
        carried = [*kept, *found, *["text"][: after is not None]]
        postings = stored(index(rows, block.vocabulary, carried), "postings")
        counts = postings.select(F.explode("term").alias("term")).groupBy("term").count().collect()  # a row per word of the block at most
        frequency = np.zeros(len(block.vocabulary), np.int64)
        frequency[[r["term"] for r in counts]] = [r["count"] for r in counts]
        rows = _found(postings, block, block.ordered(frequency), carried, slop, least)
        rows = rows.withColumns({c: F.concat(c, f"_{c}") for c in found}).drop(*(f"_{c}" for c in found))
        if after is not None:
            rows = rows.drop("n_words")
        block = after
    out = rows
    return out.withColumnsRenamed(dict(zip(kept, keep, strict=True)))


def n_hit(spans: Column) -> Column:
    """Words inside at least one span."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], s["end"]))).alias("n"), F.greatest(s["end"], x["end"]).alias("end"))
    return F.aggregate(ordered, zero, step, lambda s: s["n"])


def contaminated(n_words: Column, hits: Column, share: int = 20) -> Column:
    return (hits > 0) & (share * hits >= n_words)


def clean(documents: DataFrame, benchmark: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The documents that aren't contaminated, with their columns. The keys of the others are broadcast up to ``broadcast_rows``."""
    key, gone_key = F.xxhash64("doc_id", "text"), working_name("_gone_key", documents.columns)
    found = matches(documents.select(key.alias("key"), "text"), benchmark, ("key",))
    gone = stored(found.where(contaminated(F.col("n_words"), n_hit(F.col("spans")))).select(F.col("key").alias(gone_key)).distinct(), "contaminated")
    side = F.broadcast(gone) if gone.count() <= broadcast_rows else gone
    return documents.join(side, key == F.col(gone_key), "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("spans", lambda x: x["item_id"])))
    found = found.select("doc_id", "n_words", n_hit(F.col("spans")).alias("n_hit"), items.alias("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM b WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, n, w[s] AS f, list_slice(w, s, s + n - 1) AS x FROM i),
p AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS s FROM d),
m AS (SELECT r, item_id, s, n FROM p JOIN v ON p.w[p.s] = v.f AND list_slice(p.w, p.s, p.s + n - 1) = v.x),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS q FROM m) GROUP BY r),
t AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS items FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
