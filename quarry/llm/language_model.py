"""Language-model scoring with a hierarchical Pitman-Yor model over the whole vocabulary.

Tokens are words and one end per text. Every word (and the start of a text) is a context with a restaurant of its own that
seats its followers; every table it opens sends a customer to the unigram restaurant that all contexts share as their
parent; the parent's base is uniform over all words and one unknown word. Seats are sampled by Gibbs sweeps (``seating``).
The predictive probabilities p(w | u) = (c - d t + (strength + d t_u) p(w)) / (strength + c_u) are averaged themselves over
the sweeps after ``burn_in``, each formed of its own sweep's tables and parent probabilities.

Nothing is left out and nothing that grows with the input reaches the driver or one task:

* Pairs of words are counted once over all texts and dealt by context to buckets of about ``rows`` occurrences each. A
  context that alone would hold more than a bucket's share is dealt to several, by word; its tables are then totals of the
  sweep before. At most 65,536 contexts can be so, and only their totals are sent to all tasks.
* A sweep is two shuffles of arrays (``_deal``): each bucket tells the words' buckets how many tables its contexts opened for
  each word; these seat the parent and answer with the parent's probabilities in the order asked. The words and their counts
  are told once; from then on both sides know the order, and of a pair only the place of its word's answer, its count and
  its tables are dealt, in a few bytes (``First``).
* The last sweep runs in ``blocks`` blocks of buckets, one after another, so that the shuffle of one block at a time is on disk.
* Every pair of any text, seen in training or not, has its averaged probability in its bucket. Texts look up the ``frequent``
  most frequent pairs on the spot; the other occurrences meet their pairs in the pairs' buckets, in as many blocks, and the sums
  meet by document with its id, so texts aren't read again for it.

Edge cases: a null or empty text has its end token only. Repeated rows and null ids are scored each for itself. Words and
pairs of equal counts are treated alike, so ties don't matter. Without training documents all probabilities are those of
the base. An empty table gives an empty result. Very long texts are read whole, one at a time. Only named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _deal, _text, seating
from ._store import drop, held_out, stored, table

END, START = np.uint64(0), np.uint64(1)
_CHUNK = 2_000_000
_SPLIT = 1 << 16
_PLAIN = {"parquet.enable.dictionary": "false"}  # each packed array is a value of its own
PAIRS, SEATS, TOLD, HOT, PARENTS, ANSWERS, SCORES, ASKED, SUMS, SENT, SEEN, OFTEN, ROWS = range(13)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of a slice, with each text's end, and the index of each text's first token."""
    starts, ends, first = _text.word_bounds(data, offsets, _text.SPACE)
    hashes = _text.word_codes(data, starts, ends)
    return np.insert(hashes, first[1:], END), first + np.arange(len(first))


def contexts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[first[:-1]] = START
    return before


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return _text.mix(_text.mix(context) + word * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Dealing:
    """How pairs are dealt: contexts of more than a bucket's share (sorted) go to several buckets."""

    buckets: int
    context: np.ndarray
    parts: np.ndarray
    n: np.ndarray  # customers

    def of(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        out, at = _text.mix(context ^ np.uint64(0x5851F42D4C957F2D)), _text.lookup(self.context, context)
        k = np.flatnonzero(at >= 0)
        if len(k):
            out[k] += _text.mix(word[k] ^ np.uint64(0x2545F4914F6CDD1D)) % self.parts[at[k]].astype(np.uint64)
        return (out % np.uint64(self.buckets)).astype(np.int64)

    def of_word(self, word: np.ndarray) -> np.ndarray:
        return (_text.mix(word ^ np.uint64(0x14057B7EF767814F)) % np.uint64(self.buckets)).astype(np.int64)


def _summed(keys: np.ndarray, *values: np.ndarray):
    """Index of a row of each different key, and the sums of the values by key."""
    order = _text.order_of(keys)
    ranked = keys[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    return (order[new], *(np.add.reduceat(v[order], new) if len(new) else v[:0] for v in values))


def _occurring(keys: np.ndarray, train: np.ndarray, kind):
    """Index of a row of each different key, and how many rows of it are in the texts to learn from, and in all."""
    order = _text.order_of(keys)
    ranked = keys[order]
    new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(ranked) else np.zeros(0, np.int64)
    n = np.add.reduceat(train[order], new, dtype=kind) if len(new) else np.zeros(0, kind)
    return order[new], n, np.diff(new, append=len(ranked)).astype(kind)


def _counted(dealing: Dealing | None, parts: int = 1):
    """Counts of words to ``parts`` buckets, or of pairs by their buckets: in the texts to learn from, and in all."""

    def run(batches):
        waiting, held = [], 0

        def flush():
            context, word, train = (np.concatenate(x) for x in zip(*waiting, strict=True)) if waiting else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool))
            kind = np.int64 if dealing is None else np.int32
            k, n, every = _occurring(word if dealing is None else pair_keys(context, word), train, kind)
            if dealing is None:
                return _deal.rows((_text.mix(word[k]) % np.uint64(parts)).astype(np.int64), PAIRS, 0, word[k], n, every)
            order = _text.order_of(context[k])  # equal contexts side by side pack well
            k, n, every = k[order], n[order], every[order]
            return _deal.rows(dealing.of(context[k], word[k]), PAIRS, 0, context[k], word[k], n, every)

        for batch in batches:
            learns = batch.column("train").to_numpy(zero_copy_only=False)
            for i, _, data, offsets in _text.slices(batch.column("text")):
                word, first = tokens(data, offsets)
                waiting.append((word if dealing is None else contexts(word, first), word, np.repeat(learns[i : i + len(first) - 1], np.diff(first))))
                held += len(word)
                if held > _CHUNK:
                    yield flush()
                    waiting, held = [], 0
        yield flush()

    return run


@dataclass
class Words:
    """A bucket's number of words seen in training, their tokens in training and in all; and the words that may be a bucket's share, with theirs."""

    least: float

    def __call__(self, bucket, held):
        word = _deal.joined(held[PAIRS], 1, np.uint64)
        k, n, every = _summed(word, *(_deal.joined(held[PAIRS], c, np.int64) for c in (2, 3)))
        yield _deal.row(bucket, PAIRS, x=int(n.sum()), y=int(every.sum()))
        yield _deal.row(bucket, SEEN, x=int((n > 0).sum()))
        own = np.flatnonzero(every > self.least)
        if len(own):
            yield _deal.row(bucket, HOT, word[k[own]], n[own], every[own])


def _merged(bucket, held):
    """A bucket's pairs by (context, word), and how many of them were seen once and twice."""
    context, word = (_deal.joined(held[PAIRS], c, np.uint64) for c in (1, 2))
    n, every = (_deal.joined(held[PAIRS], c, np.int32).astype(np.int64) for c in (3, 4))
    k, n, every = _summed(pair_keys(context, word), n, every)
    context, word = context[k], word[k]
    order = _text.order_of(word)
    order = order[_text.order_of(context[order])]
    yield _deal.row(bucket, PAIRS, context[order], word[order], _deal.small(n[order]), _deal.small(every[order]), x=int((n == 1).sum()), y=int((n == 2).sum()))


def _seeds(context: np.ndarray, word: np.ndarray, seed: int) -> np.ndarray:
    return _text.mix(pair_keys(context, word) ^ np.uint64(seed))


def predicted(n, tables, opened, customers, p, discount: float, strength: float):
    """p(w | u) of one sample: n customers at ``tables`` tables of w, of ``customers`` at ``opened`` in u; p of the parent."""
    return (n - discount * tables + (strength + discount * opened) * p) / (strength + customers)


@dataclass
class First:
    """What the sweeps need of a bucket's pairs, in a few bytes each, and the first tables, one for each pair seen in training.

    The words' answers come by the word's bucket, then by word; each pair keeps the place of its word's answer. Words and
    their training counts are told once, as their order stays.
    """

    dealing: Dealing
    rank: int = 1 << 30  # of the pairs that are sent to all tasks

    def __call__(self, bucket, held):
        context, word = (_deal.joined(held[PAIRS], c, np.uint64) for c in (1, 2))
        n, every = (_deal.counts(held[PAIRS], c) for c in (3, 4))
        new = np.concatenate([[True], context[1:] != context[:-1]]) if len(context) else np.zeros(0, bool)
        number, start = np.cumsum(new) - 1, np.flatnonzero(new)
        asked, at = _text.uniques(word)
        home = self.dealing.of_word(asked)
        place = np.empty(len(asked), np.int64)
        place[np.argsort(home, kind="stable")] = np.arange(len(asked))
        split = _text.lookup(self.dealing.context, context[start])
        own = np.flatnonzero(split >= 0)
        yield _deal.row(bucket, SEEN, _deal.small(np.diff(np.append(start, len(context)))), place[at].astype(np.int32), _deal.small(n), np.stack([own, split[own]]).astype(np.int64))
        k = np.flatnonzero(_ranks(every) >= self.rank)
        yield _deal.row(bucket, OFTEN, k, pair_keys(context[k], word[k]))
        tables = np.minimum(n, 1)
        if len(own):
            yield _deal.row(bucket, HOT, split[own], np.bincount(number, tables, len(start)).astype(np.int64)[own])
        yield _deal.rows(home, TOLD, bucket, asked, *(np.bincount(at, v, len(asked)).astype(np.int64) for v in (tables, n)))


@dataclass
class Sweep:
    """One sweep of a bucket's restaurants: what the parent answered, and whether its sample counts."""

    discount: float
    strength: float
    seed: int
    base: float  # of the parent's probabilities (x + base) / whole
    whole: float
    weight: float  # of the last sample in the average
    opened: np.ndarray  # tables of the contexts that are dealt to several buckets
    customers: np.ndarray  # theirs
    last: bool = False

    def __call__(self, bucket, held):
        sizes, at, n = _deal.counts(held[SEEN], 1), _deal.joined(held[SEEN], 2, np.int32), _deal.counts(held[SEEN], 3)
        own, split = _deal.joined(held[SEEN], 4, np.int64).reshape(2, -1)
        number = np.repeat(np.arange(len(sizes)), sizes)
        k = np.flatnonzero(n > 1)  # a pair seen once has one table
        tables, kept = np.minimum(n, 1), _deal.joined(held[SEATS], 2, np.float32)
        if held[SEATS]:
            tables[k] = _deal.counts(held[SEATS], 1)
        answers = _deal.joined(held[ANSWERS], 1, float)
        p = ((answers + self.base) / self.whole)[at]
        totals = np.bincount(number, tables, len(sizes))
        totals[own] = self.opened[split]
        if self.weight:
            customers = np.bincount(number, n, len(sizes))
            customers[own] = self.customers[split]
            kept = (kept if len(kept) else 0.0) + self.weight * predicted(n, tables, totals[number], customers[number], p, self.discount, self.strength)
        if self.last:
            of_word = _deal.joined(held[ANSWERS], 2, np.int64)[at]
            yield _deal.row(bucket, SCORES, np.log10(kept).astype(np.float32), of_word)
            k = _deal.joined(held[OFTEN], 1, np.int64)
            yield _deal.row(bucket, SENT, _deal.joined(held[OFTEN], 2, np.uint64), np.log10(kept[k]), of_word[k])
            return
        if len(k):
            dense, restaurant = np.unique(number[k], return_inverse=True)
            tables[k] = seating.sweep(restaurant, n[k], tables[k], totals[dense], p[k], self.discount, self.strength, _seeds(np.full(1, bucket, np.uint64), k.astype(np.uint64), self.seed))
        yield _deal.row(bucket, SEATS, _deal.small(tables[k]), np.asarray(kept, np.float32))
        if len(own):
            yield _deal.row(bucket, HOT, split, np.bincount(number, tables, len(sizes)).astype(np.int64)[own])
        home = np.repeat([r[0] for r in held[ANSWERS]], [len(r[1]) // 8 for r in held[ANSWERS]])
        yield _deal.rows(home, TOLD, bucket, np.bincount(at, tables, len(answers)).astype(np.int64))


@dataclass
class Parent:
    """The parent's tables of a word bucket, each dish from the total of the sweep before, and answers to all who told."""

    total: float
    discount: float
    strength: float
    types: int
    seed: int
    last: bool = False

    def __call__(self, bucket, held):
        told = held[TOLD]
        sizes = [len(r[1]) // 8 for r in told]
        if held[PARENTS]:  # all tell again, in the same order
            before, words, at, of_word = (_deal.joined(held[PARENTS], c, t) for c, t in ((1, np.int64), (2, np.uint64), (3, np.int32), (4, np.int64)))
            tables = _deal.joined(told, 1, np.int64)
        else:
            words, at = _text.uniques(_deal.joined(told, 1, np.uint64))
            before, tables = np.zeros(len(words), np.int64), _deal.joined(told, 2, np.int64)
            of_word = np.bincount(at, _deal.joined(told, 3, np.int64), len(words)).astype(np.int64)
        customers = np.bincount(at, tables, len(words)).astype(np.int64)
        others = np.maximum(self.total - before, 0).astype(float)
        start = np.minimum(np.maximum(before, np.minimum(customers, 1)), customers)
        seated = seating.draw(customers, start, others, np.full(len(words), 1 / (self.types + 1)), self.discount, self.strength, _seeds(np.zeros(1, np.uint64), words, self.seed))
        yield _deal.row(bucket, PARENTS, *(() if self.last else (seated, words, at.astype(np.int32), of_word)), x=int(customers.sum()), y=int(seated.sum()))
        yield _deal.rows(np.repeat([r[0] for r in told], sizes), ANSWERS, bucket, (customers - self.discount * seated)[at], *((of_word[at],) if self.last else ()))


def _of_two(one: int, two: int) -> float:
    """A discount from the numbers of dishes with one and with two customers."""
    return float(np.clip(one / (one + 2 * two), 0.1, 0.95)) if one else 0.5


@dataclass
class Model:
    """The pairs of all texts with their averaged probabilities, and the fit's scalars."""

    pairs: DataFrame  # by bucket: contexts, words, occurrences in training and in all texts, packed
    scores: DataFrame  # in the same order: log10 p(w | u), training tokens of w
    dealing: Dealing
    n_train: int
    n_types: int
    discount: float
    strength: float

    def base_log(self, n):
        return np.log10((np.asarray(n, float) + 0.5) / (self.n_train + 0.5 * (self.n_types + 1)))


def fit(documents: DataFrame, learns: Column, sweeps: int = 3, burn_in: int = 1, strength: float = 1.0, rows: int = 1_000_000, blocks: int = 2, frequent: int = 1 << 19, seed: int = 7) -> Model:
    """Learn from the rows of ``documents`` for which ``learns`` holds; pairs of the others are only given their probabilities."""
    texts = documents.select(F.coalesce(learns, F.lit(False)).alias("train"), "text")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stored(_deal.met(texts.mapInArrow(_counted(None, parts), _deal.SCHEMA), parts).mapInArrow(_deal.each(Words(rows / 2)), _deal.SCHEMA), "words")
    told = {r["kind"]: r for r in counts.groupBy("kind").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).collect()}
    n_train, every, n_types = (int(told[kind][c]) if kind in told else 0 for kind, c in ((PAIRS, "x"), (PAIRS, "y"), (SEEN, "x")))
    buckets = max(1, -(-every // rows))
    share = max(every / min(buckets, _SPLIT), 1.0)  # fewer than _SPLIT words have more; over rows / 2 if there are several buckets
    hot = counts.where(F.col("kind") == HOT).mapInArrow(_hot, "word long, n long, every long").where(F.col("every") > share).collect() if buckets > 1 else []
    drop(counts)
    hot = sorted((int(START) if r["word"] == int(END) else r["word"] % (1 << 64), -(-r["every"] * buckets // every), r["n"]) for r in hot)  # texts start as often as they end
    dealing = Dealing(buckets, *(np.array([r[i] for r in hot], kind) for i, kind in enumerate((np.uint64, np.int64, np.int64))))
    pairs = stored(_deal.met(texts.mapInArrow(_counted(dealing), _deal.SCHEMA), buckets).mapInArrow(_deal.each(_merged), _deal.SCHEMA), "pairs", "zstd", **_PLAIN)
    told = pairs.agg(F.sum("x"), F.sum("y")).first()
    discount, parent_discount = _of_two(int(told[0] or 0), int(told[1] or 0)), 0.5

    def of(df, *kinds):
        return df.where(F.col("kind").isin(*kinds))

    first = stored(pairs.mapInArrow(_deal.each(First(dealing, _limit(pairs, frequent))), _deal.SCHEMA), "seats", "zstd", **_PLAIN)
    parents, total, seats, written = None, 0, first, []
    for sweep in range(sweeps + 1):
        last = sweep == sweeps
        rows_in = of(seats, TOLD) if parents is None else of(seats, TOLD).union(of(parents, PARENTS))
        answers = stored(_deal.met(rows_in, buckets).mapInArrow(_deal.each(Parent(total, parent_discount, strength, n_types, seed + sweep, last)), _deal.SCHEMA), "parents", "zstd", **_PLAIN)
        if parents is not None:
            drop(parents)
        parents = answers
        told = of(parents, PARENTS).agg(F.sum("x"), F.sum("y")).first()
        customers, total = int(told[0] or 0), int(told[1] or 0)
        opened = np.zeros(len(dealing.context))
        if len(opened):
            for r in of(seats, HOT).mapInArrow(_opened, "context long, t long").groupBy("context").agg(F.sum("t").alias("t")).collect():  # at most _SPLIT
                opened[r["context"]] = r["t"]
        weight = 1 / max(sweeps - burn_in, 1) if sweep > min(burn_in, sweeps - 1) else 0.0
        step = Sweep(discount, strength, seed + 100 + sweep, (strength + parent_discount * total) / (n_types + 1), strength + customers, weight, opened, dealing.n, last)
        after, cut = [], blocks if last else 1  # until then few bytes of a pair are dealt
        for block in range(cut):
            rows_in = of(first, SEEN, *([OFTEN] if last else [])).union(of(parents, ANSWERS))
            rows_in = (rows_in if seats is first else rows_in.union(of(seats, SEATS))).where(F.col("bucket") % cut == block)
            after.append(stored(_deal.met(rows_in, buckets).mapInArrow(_deal.each(step), _deal.SCHEMA), "scores" if last else "seats", "zstd", **_PLAIN))
        for x in written:
            drop(x)
        written, seats = after, reduce(DataFrame.union, after)
    drop(parents)
    drop(first)
    return Model(pairs, seats, dealing, n_train, n_types, discount, strength)


def _hot(batches):
    for batch in batches:
        for held in zip(*(batch.column(c) for c in "abc"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in held], ["word", "n", "every"])


def _opened(batches):
    for batch in batches:
        for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x.as_buffer(), np.int64)) for x in (a, b)], ["context", "t"])


def _ranks(every: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(every) * 8).astype(np.int64)


def _ranked(batches):
    for batch in batches:
        for d in batch.column("d"):
            rank, n = np.unique(_ranks(_deal.counts([[d.as_buffer()]], 0)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(n)], ["rank", "n"])


def _limit(pairs: DataFrame, most: int) -> int:
    """The smallest rank from which on there are at most ``most`` pairs, from a histogram of a few hundred rows."""
    left, limit = most, 1 << 30
    ranks = pairs.select("d").mapInArrow(_ranked, "rank long, n long").groupBy("rank").agg(F.sum("n").alias("n")).collect()
    for rank, n in sorted(((r["rank"], r["n"]) for r in ranks), reverse=True):
        left -= n
        if left < 0:
            break
        limit = rank
    return limit


class Frequent:
    """What is sent to all tasks: at most ``frequent`` pairs, whatever the input."""

    def __init__(self, model: Model):
        rows = model.scores.where(F.col("kind") == SENT).select("a", "b", "c").collect()
        keys, score, n = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) if rows else np.zeros(0, t) for c, t in (("a", np.uint64), ("b", float), ("c", np.int64)))
        order = np.argsort(keys)
        self.places, self.score, self.n = _text.Places(keys[order]), score[order], n[order]
        self.base = model.base_log(self.n)


def _asking(sent, dealing: Dealing, block: int, blocks: int):
    """Of the pairs of a block of buckets: a text's sums over the frequent ones, and (pair, document) of all others; with the first block the rows themselves."""

    def run(batches):
        f = sent.value
        for batch in batches:
            keys, asked, sums = batch.column("key").to_numpy(), [], []
            for i, j, data, offsets in _text.slices(batch.column("text")):
                word, first = tokens(data, offsets)
                context, row = contexts(word, first), np.repeat(np.arange(j - i), np.diff(first))
                bucket = dealing.of(context, word)
                own = np.flatnonzero(bucket % blocks == block)
                bucket, row, pair = bucket[own], row[own], pair_keys(context[own], word[own])
                at = f.places.of(pair)
                k, here = np.flatnonzero(at < 0), np.flatnonzero(at >= 0)
                asked.append((bucket[k], pair[k], keys[i:j][row[k]]))
                at, of = at[here], row[here]
                score, base, known = (np.bincount(of, v[at], j - i) for v in (f.score, f.base, f.n > 0))
                sums.append((keys[i:j], score, base, np.stack([known, np.bincount(row, minlength=j - i)], 1).astype(np.int64)))
            if asked:
                bucket, pair, key = (np.concatenate(x) for x in zip(*asked, strict=True))
                yield _deal.rows(bucket, ASKED, 0, pair, key)
                key, *values = (np.concatenate(x) for x in zip(*sums, strict=True))
                home = dealing.of_word(key.view(np.uint64))
                yield _deal.rows(home, SUMS, 0, key, *values)
                if not block:
                    id_, train = batch.column("doc_id"), batch.column("train").to_numpy(zero_copy_only=False)
                    yield _deal.rows(home, ROWS, 0, key, id_.fill_null(0).to_numpy(), train, id_.is_null().to_numpy(zero_copy_only=False))

    return run


@dataclass
class Answered:
    """Occurrences meet their pairs; a document's sums go to the document's bucket."""

    model: Model

    def __call__(self, bucket, held):
        if held[SUMS]:
            yield _deal.row(bucket, SUMS, *(_deal.joined(held[SUMS], c, t) for c, t in ((1, np.int64), (2, float), (3, float), (4, np.int64))))
        if held[ROWS]:
            yield _deal.row(bucket, ROWS, *(_deal.joined(held[ROWS], c, t) for c, t in ((1, np.int64), (2, np.int64), (3, bool), (4, bool))))
        if not held[ASKED]:
            return
        pair, key = _deal.joined(held[ASKED], 1, np.uint64), _deal.joined(held[ASKED], 2, np.int64)
        keys = pair_keys(*(_deal.joined(held[PAIRS], c, np.uint64) for c in (1, 2)))
        order = _text.order_of(keys)
        at = order[_text.Places(keys[order]).of(pair)]
        n = _deal.joined(held[SCORES], 2, np.int64)[at]
        k, score, base, known = _summed(key.view(np.uint64), _deal.joined(held[SCORES], 1, np.float32)[at].astype(float), self.model.base_log(n), (n > 0).astype(np.int64))
        key = key[k]
        yield _deal.rows(self.model.dealing.of_word(key.view(np.uint64)), SUMS, bucket, key, score, base, np.stack([known, np.zeros_like(known)], 1))


def _told(bucket, held):
    """Rows equal in id and text share a key: a key's sums are those of all its rows."""
    key, counts = _deal.joined(held[SUMS], 1, np.int64), _deal.joined(held[SUMS], 4, np.int64).reshape(-1, 2)
    k, *sums = _summed(key.view(np.uint64), *(_deal.joined(held[SUMS], c, float) for c in (2, 3)), counts[:, 0], counts[:, 1])
    own, doc_id, train, none = (_deal.joined(held[ROWS], c, t) for c, t in ((1, np.uint64), (2, np.int64), (3, bool), (4, bool)))
    at = np.searchsorted(key[k].view(np.uint64), own)
    rows = np.bincount(at, minlength=len(k))[at]
    score, base, known, n = (v[at] for v in sums)
    yield pa.RecordBatch.from_arrays([pa.array(doc_id, mask=none), pa.array(train), pa.array(n // rows), pa.array(known // rows), pa.array(base / rows), pa.array(score / rows)], ["doc_id", "train", "n_tokens", "n_known", "base_score", "score"])


def scored(documents: DataFrame, learns: Column, blocks: int = 2, frequent: int = 1 << 19, **options) -> tuple[DataFrame, Model]:
    """doc_id, train, n_tokens, n_known, base_score, score and perplexity of every document, and the model of those that ``learns`` names."""
    model = fit(documents, learns, blocks=blocks, frequent=frequent, **options)
    dealing = model.dealing
    sent = documents.sparkSession.sparkContext.broadcast(Frequent(model))
    doc_id = F.col("doc_id").cast("long")
    texts = documents.select(F.xxhash64(doc_id, "text").alias("key"), doc_id.alias("doc_id"), F.coalesce(learns, F.lit(False)).alias("train"), "text")
    answered = Answered(Model(None, None, dealing, model.n_train, model.n_types, model.discount, model.strength))
    parts = []
    for block in range(blocks):
        known = model.pairs.withColumns({c: F.lit(None).cast("binary") for c in "cd"}).union(model.scores.where(F.col("kind") == SCORES)).where(F.col("bucket") % blocks == block)
        asked = texts.mapInArrow(_asking(sent, dealing, block, blocks), _deal.SCHEMA).union(known)
        parts.append(stored(_deal.met(asked, dealing.buckets).mapInArrow(_deal.each(answered), _deal.SCHEMA), "gains", "zstd", **_PLAIN))
    out = _deal.met(reduce(DataFrame.union, parts), dealing.buckets).mapInArrow(_deal.each(_told), "doc_id long, train boolean, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))), model


def op10_language_model(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, model = scored(documents, ~held_out(5))
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(model.n_train).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
