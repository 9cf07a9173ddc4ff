"""Exact top-k search with BM25, block-max WAND and merged documents.

A query asks for every distinct word of its document that another one shares, so it may hold hundreds. Impacts come from
the collection's statistics, counted over all documents beforehand, so the best of parts can be merged.

The search climbs a ladder: first over a share of the documents (by hash of the id) of about one shard, then over shares
``STEP`` times as large, up to all. A query's k-th score over a share is a bound that its true k-th can't be under (its
floor), and the next step's tasks tell only what reaches it: about ``STEP`` * k rows of a query at each step, however many
tasks there are.

The first step is a shard with an inverted index (postings by document, in blocks of ``BLOCK`` documents with their largest
impact). A query's terms are taken from the largest impact down, several at once in vectors; the shard's commonest words come
first, for many queries at once as a product of two matrices of bounded size. The k-th best of the sums so far is a
threshold; once the terms left can't lift a document over it by themselves, only documents whose sum and whose block's
largest impacts of these terms pass it stay, and of the terms left, which have the longest postings, only blocks that hold
such documents are read. The test is WAND's for each document and block; queries of every length take this way.

At the other steps the queries are what is indexed, and documents pass by in any order. Queries that share common words are a
group (``alike``); documents that stay far below a group's floors are merged into runs with the largest impact of each term,
and what a run doesn't reach none of its documents does. Runs are scored for a whole group at once as single floats: common
words as a product of matrices, others by the lists of the queries that ask for them. What reaches its floor but for
rounding is added up again by document in doubles. Documents are cut into words once; these go through a table.

Queries are taken in blocks of at most ``block_queries`` queries and about ``block_terms`` query terms, ``TOGETHER`` blocks at
once; further ones are a further pass over the words.

Edge cases: a null or empty text has no terms and is never found; rows without id are not searched; a query without
terms finds nothing. Scores are equal that agree to nine decimals. Rows that share an id are documents of their own; as a query, an id asks for the words of all its
rows and finds none of them. Ties are broken by the smaller id. An empty table gives an empty result. Only named columns
are read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text
from ._store import drop, stored, table

K1, B = 1.2, 0.75
BLOCK = 64
#: common words of a shard that are summed up as a matrix product, and what that matrix and its results may take
DENSE, DENSE_BYTES = 512, 1 << 25
#: postings whose impacts are worked out at once
PIECE = 1 << 18
#: queries in a group at most, and documents that meet it at once
GROUP, TILE = 16_384, 256
#: a group's common words are those that more than one of so many queries asks for; what a posting costs, in cells of the product; postings of a short list
COMMON, PRODUCT, SHORT = 32, 160, 48
#: documents that meet the queries at once; of these, how many are merged at most, and up to which share of the usual floor
READY, MERGED, ROOM = 2048, 6, 0.5
#: the share of the queries that are least like others
ODD = 0.02
#: blocks of queries that go over the texts together; results that wait in a task before each query's best are kept
TOGETHER, WAITING = 3, 1 << 18
#: how much larger the share of the documents is at each step of the ladder
STEP = 8


def _terms(data: np.ndarray, offsets: np.ndarray):
    """(document, term, frequency) of a slice, sorted by document and term, and the documents' lengths."""
    starts, ends, first = _text.word_bounds(data, offsets, _text.ALNUM)
    length = np.diff(first)
    row = np.repeat(np.arange(len(length)), length)
    term = _text.word_hashes(data, starts, ends)
    # one sort of the row's bits and as many of the hash's upper ones as there is room for
    bits = np.uint64(len(length).bit_length())
    key = (row.astype(np.uint64) << (np.uint64(64) - bits)) | (term >> bits)
    order = np.argsort(key)
    key, ranked = key[order], term[order]
    if ((key[1:] == key[:-1]) & (ranked[1:] != ranked[:-1])).any():
        order = np.lexsort((term, row))
        ranked = term[order]
    row, term = row[order], ranked
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (term[1:] != term[:-1])])) if len(row) else np.zeros(0, np.int64)
    return row[new], term[new], np.diff(np.append(new, len(row))), length


def _frequencies(batches):
    """Document frequency of each term of a task, and one row without a term: its documents and words."""
    waiting, held, n, words = [], 0, 0, 0

    def flush():
        terms, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(counts), pa.nulls(len(terms), pa.int64())], ["term", "df", "words"])

    for batch in batches:
        for _, _, data, offsets in _text.slices(batch.column("text")):
            _, term, _, length = _terms(data, offsets)
            waiting.append(term)
            held, n, words = held + len(term), n + len(length), words + int(length.sum())
            if held > 4_000_000:
                yield flush()
                waiting, held = [], 0
    yield flush()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n]), pa.array([words])], ["term", "df", "words"])


def collection(documents: DataFrame) -> tuple[DataFrame, int, float]:
    """(term, df) of all documents, stored; their number and mean length."""
    found = documents.where("doc_id is not null").select("text").mapInArrow(_frequencies, "term long, df long, words long")
    found = stored(found.groupBy("term").agg(F.sum("df").alias("df"), F.sum("words").alias("words")), "terms")
    total = found.where("term is null").first()
    n, words = (total["df"], total["words"]) if total else (0, 0)
    return found.where("term is not null").select("term", "df"), n or 0, (words or 0) / max(n or 0, 1)


def _words(batches):
    """Each document's length, terms and how often each occurs in it, in the order of the terms."""
    for batch in batches:
        for i, j, data, offsets in _text.slices(batch.column("text")):
            row, term, tf, length = _terms(data, offsets)
            first = np.searchsorted(row, np.arange(j - i + 1))
            packed = [pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((first * x.itemsize).astype(np.int32)), pa.py_buffer(x)]) for x in (term, tf.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("pick").slice(i, j - i), pa.array(length), *packed], ["doc_id", "pick", "length", "term", "tf"])


def _numbers(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that a column of binaries holds, and where each row's begin; one more at the end."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // np.dtype(dtype).itemsize
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype, offsets[-1]) if data is not None else np.zeros(0, dtype))[offsets[0] :], offsets - offsets[0]


def _query_terms(batches):
    for batch in batches:
        ids = batch.column("doc_id")
        for i, j, data, offsets in _text.slices(batch.column("text")):
            starts, ends, first = _text.word_bounds(data, offsets, _text.ALNUM)
            rows = {}
            lower = _text.LOWER[data].tobytes()
            for k in range(j - i):
                counts: dict[bytes, int] = {}
                for a, b in zip(starts[first[k] : first[k + 1]].tolist(), ends[first[k] : first[k + 1]].tolist(), strict=True):
                    counts[lower[a:b]] = counts.get(lower[a:b], 0) + 1
                rows[k] = counts
            qid = [ids[i + k].as_py() for k, c in rows.items() for _ in c]
            word = [w.decode("utf-8", "replace") for c in rows.values() for w in c]
            tf = [n for c in rows.values() for n in c.values()]
            yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(word, pa.string()), pa.array(_text.hash_words(word).view(np.int64)), pa.array(tf, pa.int64())], ["qid", "word", "term", "tf"])


def more_like(queries: DataFrame, terms: DataFrame) -> DataFrame:
    """(qid, word, term, df): each query document's distinct words that some other document can share (df over 1)."""
    own = queries.where("doc_id is not null").select("doc_id", "text").mapInArrow(_query_terms, "qid long, word string, term long, tf long")
    return own.join(terms.where("df > 1"), "term").select("qid", "word", "term", "df").distinct()


class Index:
    """A shard's postings by term and document: impacts, each term's largest one, and the same of each block of documents."""

    def __init__(self, term: np.ndarray, row: np.ndarray, impact: np.ndarray, n_terms: int, n_docs: int):
        by = np.lexsort((row, term))
        self.row, self.impact, term, self.n = row[by], impact[by], term[by], n_docs
        self.edge = np.searchsorted(term, np.arange(n_terms + 1, dtype=term.dtype))
        block = self.row // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.block, self.begin, self.end = block[new], new, np.append(new[1:], len(term))
        self.block_edge = np.searchsorted(new, self.edge)
        self.peak = np.maximum.reduceat(self.impact, new) if len(new) else np.zeros(0)
        self.most = np.zeros(n_terms)
        held = np.flatnonzero(self.edge[1:] > self.edge[:-1])
        if len(held):
            self.most[held] = np.maximum.reduceat(self.impact, self.edge[held])
        self.read = self.skipped = 0  # postings
        # the words of the longest lists as rows of a matrix of bounded size
        size = self.edge[1:] - self.edge[:-1]
        rows = min(DENSE, DENSE_BYTES // (8 * max(n_docs, 1)))
        longest = np.argpartition(-size, rows)[:rows] if rows < n_terms else np.arange(n_terms)
        self.dense = np.sort(longest[size[longest] * 16 > n_docs])
        self.matrix = np.zeros((len(self.dense), n_docs))
        for k, t in enumerate(self.dense.tolist()):
            self.matrix[k, self.row[self.edge[t] : self.edge[t + 1]]] = self.impact[self.edge[t] : self.edge[t + 1]]

    def common(self, queries: list[np.ndarray]) -> np.ndarray:
        """For each query the sums of its common words over all documents, as one product of matrices."""
        asked = np.zeros((len(queries), len(self.dense)))
        for k, terms in enumerate(queries):
            at = _text.lookup(self.dense, terms)
            asked[k, at[at >= 0]] = 1.0
        return asked @ self.matrix


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """begin[0]..end[0]-1, begin[1]..end[1]-1, ... as one array."""
    size = end - begin
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = size > 0
    begin, size = begin[full], size[full]
    at = np.cumsum(size)[:-1]
    out[0] = begin[0]
    out[at] = begin[1:] - (begin[:-1] + size[:-1] - 1)
    return np.cumsum(out)


def best(index: Index, asked: np.ndarray, k: int, skip: range = range(0), floor: float = -1.0, common: np.ndarray | None = None) -> list[tuple[float, int]]:
    """The k best (score, document) over the asked terms that score over ``floor``; equal to nine decimals, the smaller document goes first; those in ``skip`` are left out.

    common: what the query's common words add to each document, if that is known; then only its other terms are read.
    """
    score = np.zeros(index.n)
    if common is not None:
        score[:] = common
        score[skip.start : skip.stop] = 0.0
        asked = asked[_text.lookup(index.dense, asked) < 0]
    asked = asked[np.argsort(-index.most[asked], kind="stable")]
    left = np.append(np.cumsum(index.most[asked][::-1])[::-1], 0.0)  # what the terms from here on add at most
    done, least, slack, ahead = 0, floor, 1e-8, float(score.max(initial=0.0))
    while done < len(asked) and left[done] + ahead + slack >= least:
        # a floor tells how many terms matter; without one the threshold rises as terms are read
        until = int(np.searchsorted(-left, slack + ahead - floor, "right")) if floor > 0 else 2 * done + 4
        cuts = [slice(x, y) for x, y in zip(index.edge[asked[done:until]].tolist(), index.edge[asked[done:until] + 1].tolist(), strict=True)]
        at = np.concatenate([index.row[c] for c in cuts])
        score += np.bincount(at, np.concatenate([index.impact[c] for c in cuts]), index.n)
        score[skip.start : skip.stop] = 0.0
        index.read += len(at)
        done = min(until, len(asked))
        if floor <= 0 and index.n > k:
            least = max(floor, float(np.partition(score, index.n - k)[index.n - k]))
    rest = asked[done:]
    if len(rest):
        blocks = _ranges(index.block_edge[rest], index.block_edge[rest + 1])
        bound = np.bincount(index.block[blocks], index.peak[blocks], -(-index.n // BLOCK))
        live = score + np.repeat(bound, BLOCK)[: index.n] + slack >= max(least, 1e-12)
        live[skip.start : skip.stop] = False
        held = np.zeros(len(bound), bool)
        held[np.flatnonzero(live) // BLOCK] = True
        blocks = blocks[held[index.block[blocks]]]
        at = _ranges(index.begin[blocks], index.end[blocks])
        score += np.bincount(index.row[at], index.impact[at], index.n)
        score[~live] = 0.0
        index.read += len(at)
        index.skipped += int((index.edge[rest + 1] - index.edge[rest]).sum()) - len(at)
    found = np.flatnonzero(score > max(floor, 0.0))
    if len(found) > 4 * k:
        found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k] - slack]
    found = found[np.lexsort((found, -score[found].round(9)))][:k]
    return list(zip(score[found].tolist(), found.tolist(), strict=True))


def _search(sent, mean_length: float, k: int):
    def run(batches):
        terms, idf, qids, first, query_terms, floors = sent.value[:6]
        _BUILT.clear()
        parts, ids, lengths, n_docs = [], [], [], 0
        # a shard has under 2**31 documents, and a query block under 2**31 terms
        small = lambda x: x.astype(np.int32)
        for batch in batches:
            for i, j, data, offsets in _text.slices(batch.column("text")):
                row, term, tf, length = _terms(data, offsets)
                at = _text.lookup(terms, term)
                hit = at >= 0
                parts.append((small(at[hit]), small(row[hit] + n_docs), small(tf[hit])))
                ids.append(batch.column("doc_id").slice(i, j - i).to_numpy())
                lengths.append(length)
                n_docs += j - i
        if not parts:
            return
        term, row, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        own, size = np.concatenate(ids), np.concatenate(lengths)
        # documents are numbered by id, so ties fall to the smaller one
        order = np.argsort(own, kind="stable")
        number = np.empty(len(own), np.int32)
        number[order] = np.arange(len(own))
        own = own[order]
        # a share of the postings at a time, so that what is worked out on the way stays small
        impact = np.empty(len(term))
        for start in range(0, len(term), PIECE):
            t, r, f = (x[start : start + PIECE] for x in (term, row, tf))
            impact[start : start + PIECE] = idf[t] * f * (K1 + 1) / (f + K1 * (1 - B + B * size[r] / max(mean_length, 1e-9)))
        del tf
        row = number[row]
        index = Index(term, row, impact, len(terms), len(own))
        del term, row, impact
        out_q, out_d, out_s = [], [], []
        together = max(1, DENSE_BYTES // (8 * max(len(own), 1)))
        for start in range(0, len(qids), together):
            some = range(start, min(start + together, len(qids)))
            terms_of = [query_terms[first[q] : first[q + 1]] for q in some]
            for q, asked, common in zip(some, terms_of, index.common(terms_of), strict=True):
                asked = asked[index.edge[asked] < index.edge[asked + 1]]
                if not len(asked):
                    continue
                skip = range(int(np.searchsorted(own, qids[q])), int(np.searchsorted(own, qids[q], "right")))
                found = best(index, asked, k, skip, floors[q], common)
                out_q += [int(qids[q])] * len(found)
                out_d += [int(own[d]) for _, d in found]
                out_s += [s for s, _ in found]
        yield pa.RecordBatch.from_arrays([pa.array(out_q, pa.int64()), pa.array(out_d, pa.int64()), pa.array(out_s, pa.float64())], ["qid", "doc_id", "score"])

    return run


class Group:
    """Queries that are alike, by term: who asks for it. The terms that many of them ask for are rows of a matrix of bounded size, the commonest first."""

    def __init__(self, first: np.ndarray, asked: np.ndarray, n_terms: int):
        self.n = len(first) - 1
        both = (asked.astype(np.int64) << 32) | np.repeat(np.arange(self.n), np.diff(first))
        both.sort()
        self.query = (both & 0xFFFFFFFF).astype(np.uint16)
        size = np.bincount(asked, minlength=n_terms)
        self.edge = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        rows = min(DENSE, DENSE_BYTES // (4 * max(self.n, 1)))
        common = np.flatnonzero(size * COMMON > self.n)
        common = common[np.argsort(-size[common], kind="stable")][:rows]
        self.place = np.full(n_terms, -1, np.int32)
        self.place[common] = np.arange(len(common))
        self.matrix = np.zeros((len(common), self.n), np.float32)
        for k, t in enumerate(common.tolist()):
            self.matrix[k, self.query[self.edge[t] : self.edge[t + 1]]] = 1.0

    def merged(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, m: int, usual: np.ndarray):
        """Documents in runs whose largest impacts together stay well below the usual query's floor: (documents in order, where runs begin, (run, term, impact)).

        usual: how much an impact of a term adds to queries' scores on the average, in parts of their floors. What a run's
        largest impacts don't reach none of its documents does."""
        held = np.flatnonzero(self.edge[term] < self.edge[term + 1])
        doc, term, impact = doc[held], term[held], impact[held]
        reach = np.bincount(doc, impact * usual[term], m)
        order = np.argsort(reach)
        together = np.clip((ROOM / np.maximum(reach[order], 1e-9)) ** 1.3, 1.0, MERGED)
        run = np.floor(np.cumsum(1 / together) - 1e-9).astype(np.int64)
        begin = np.flatnonzero(np.diff(run, prepend=-1))
        run_of = np.empty(m, np.int64)
        run_of[order] = np.cumsum(np.diff(run, prepend=-1) > 0) - 1
        key = (run_of[doc] << 32) | term
        by = np.argsort(key)
        key = key[by]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        impact = np.maximum.reduceat(impact[by], new) if len(new) else np.zeros(0)
        return order, np.append(begin, m), (key[new] >> 32, key[new] & 0xFFFFFFFF, impact)

    def sums(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, m: int) -> np.ndarray:
        """Scores of m documents for all queries as single floats; (doc, term, impact) are in the order of the documents."""
        begin, end, place, impact = self.edge[term], self.edge[term + 1], self.place[term], impact.astype(np.float32)
        size = end - begin
        # as many rows of the matrix as spare more work on lists than they cost
        spared = np.bincount(place[place >= 0], size[place >= 0], len(self.matrix)) * PRODUCT - self.n * m
        rows = int(np.argmax(np.cumsum(np.append(0.0, spared))))
        dense = (place >= 0) & (place < rows)
        weights = np.zeros((m, rows), np.float32)
        weights[doc[dense], place[dense]] = impact[dense]
        out = weights @ self.matrix[:rows]
        # short lists all at once, others list by list
        short = np.flatnonzero(~dense & (size <= SHORT))
        at = self.query[_ranges(begin[short], end[short])] + np.repeat(doc[short] * self.n, size[short])
        np.add.at(out.reshape(-1), at, np.repeat(impact[short], size[short]))
        long = np.flatnonzero(~dense & (size > SHORT))
        first = np.searchsorted(doc[long], np.arange(m + 1)).tolist()
        cuts = list(zip(begin[long].tolist(), end[long].tolist(), strict=True))
        size, impact, query = size[long], impact[long], self.query
        for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            if a < b:
                np.add.at(out[d], np.concatenate([query[x:y] for x, y in cuts[a:b]]).astype(np.intp), np.repeat(impact[a:b], size[a:b]))
        return out


class Asked(NamedTuple):
    """A pass's queries: ``terms`` sorted with their ``idf``; query q asks for ``asked[first[q]:first[q + 1]]``; those of cuts[g]..cuts[g + 1] are a group, for which documents are merged if ``merging[g]``."""

    terms: np.ndarray
    idf: np.ndarray
    qids: np.ndarray
    first: np.ndarray
    asked: np.ndarray
    floors: np.ndarray
    cuts: np.ndarray
    merging: np.ndarray


_BUILT: dict = {}


def _groups(sent) -> tuple[_text.Places, list[Group]]:
    """Of the pass at work, built once by a worker for all its tasks."""
    if sent not in _BUILT:
        _BUILT.clear()
        x = sent.value
        groups = [Group(x.first[a : b + 1] - x.first[a], x.asked[x.first[a] : x.first[b]], len(x.terms)) for a, b in zip(x.cuts[:-1].tolist(), x.cuts[1:].tolist(), strict=True)]
        _BUILT[sent] = _text.Places(x.terms), groups
    return _BUILT[sent]


def _usual(sent, told) -> list[np.ndarray]:
    """For each group what merged() needs to know of its queries' floors."""
    if (sent, told) not in _BUILT:
        for key in [x for x in _BUILT if x != sent]:
            del _BUILT[key]
        x, out = sent.value, []
        for a, b, merging in zip(x.cuts[:-1].tolist(), x.cuts[1:].tolist(), x.merging.tolist(), strict=True):
            if merging:
                share = np.repeat(1 / np.maximum(told.value[a:b], 1e-3), np.diff(x.first[a : b + 1])) / (b - a)
                out.append(np.bincount(x.asked[x.first[a] : x.first[b]], share, len(x.terms)).astype(np.float32))
            else:
                out.append(np.full(len(x.terms), np.inf, np.float32))
        _BUILT[sent, told] = out
    return _BUILT[sent, told]


def alike(first: np.ndarray, asked: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of queries in which those that share common words stand together, where groups of up to ``GROUP`` begin and end in it, and whether they are alike; those that are like no others come last.

    Any order gives the same results; a good one makes the groups' work small."""
    n = len(first) - 1
    if not n:
        return np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, bool)
    kinds = max(1, min(8, n // 2048))
    common = np.argsort(-np.bincount(asked, minlength=n_terms), kind="stable")[:256]
    place = np.full(n_terms, -1, np.int64)
    place[common] = np.arange(len(common))
    who, place = np.repeat(np.arange(n), np.diff(first)), place[asked]
    has = np.zeros((n, len(common)), np.float32)
    has[who[place >= 0], place[place >= 0]] = 1.0
    words = has.sum(axis=1, keepdims=True)
    has /= np.sqrt(np.maximum(words, 1.0))
    usual = has[words[:, 0] >= np.median(words)]
    middle = usual[:1]
    while len(middle) < kinds:  # at first those that are farthest from all middles so far
        middle = np.concatenate([middle, usual[[np.argmin((usual @ middle.T).max(axis=1))]]])
    for _ in range(8):
        near = has @ middle.T
        kind = np.argmax(near, axis=1)
        middle = np.stack([has[kind == j].sum(axis=0) for j in range(kinds)])
        middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-9)
    same = (middle @ middle.T > 0.5).argmax(axis=1)  # parts of one kind
    near, kind = near.max(axis=1), same[kind]
    kind[near < np.quantile(near, ODD)] = kinds
    order = np.argsort(kind, kind="stable")
    cuts, merging = [0], []
    for j, size in enumerate(np.bincount(kind).tolist()):
        parts = -(-size // GROUP)
        cuts += [cuts[-1] + size * x // parts for x in range(1, parts + 1)]
        merging += [j < kinds] * parts
    return order, np.array(cuts), np.array(merging)


def _meet(sent, told, mean_length: float, k: int):
    """The k best documents of a task for each query, of those that score over its floor; documents pass by in tiles."""

    def run(batches):
        asked = sent.value
        places, groups = _groups(sent)
        terms_of = np.diff(asked.first)
        floors, held, waiting = told.value.copy(), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), []
        where = np.zeros(len(asked.terms), np.int32)
        usual = _usual(sent, told)

        def bars():
            """What a score as single floats, summed in any order, reaches if the true one passes the floor."""
            return np.where(floors > 0, floors * (1 - (terms_of + 16) * 2.0**-23) - 1e-6, 0).clip(1e-30).astype(np.float32)

        def kept():
            """The k best of each query so far; their least score is a floor."""
            query, doc, score = (np.concatenate(x) for x in zip(held, *waiting, strict=True))
            waiting.clear()
            order = np.lexsort((doc, -score.round(9), query))
            query, doc, score = query[order], doc[order], score[order]
            rank = np.arange(len(query)) - np.searchsorted(query, query)
            full = rank == k - 1
            floors[query[full]] = np.maximum(floors[query[full]], _floor(score[full]))
            return query[rank < k], doc[rank < k], score[rank < k]

        def meet(ids, doc, term, impact):
            """All queries and some documents."""
            first = np.searchsorted(doc, np.arange(len(ids) + 1))
            for g, group in enumerate(groups):
                own = slice(int(asked.cuts[g]), int(asked.cuts[g + 1]))
                order, begin, (run, run_term, run_impact) = group.merged(doc, term, impact, len(ids), usual[g])
                tiles = -(-(len(begin) - 1) // TILE)
                for t in range(tiles):
                    lo, hi = ((len(begin) - 1) * x // tiles for x in (t, t + 1))
                    some = slice(*np.searchsorted(run, [lo, hi]).tolist())
                    found, query = np.divmod(np.flatnonzero(group.sums(run[some] - lo, run_term[some], run_impact[some], hi - lo) >= bar[own]), group.n)
                    query, edge = query + own.start, np.searchsorted(run, np.arange(lo, hi + 1))
                    of = np.append(np.flatnonzero(np.diff(found, prepend=-1)), len(found)).tolist()
                    for a, b in zip(of[:-1], of[1:], strict=True):
                        p, q = int(found[a]), query[a:b]
                        docs, words = order[begin[lo + p] : begin[lo + p + 1]], run_term[edge[p] : edge[p + 1]]
                        where[words] = np.arange(1, len(words) + 1)
                        impacts = np.zeros((len(docs), len(words) + 1))
                        for k, d in enumerate(docs.tolist()):
                            impacts[k, where[term[first[d] : first[d + 1]]]] = impact[first[d] : first[d + 1]]
                        wanted = where[np.concatenate([asked.asked[x:y] for x, y in zip(asked.first[q].tolist(), asked.first[q + 1].tolist(), strict=True)])]
                        shared = np.flatnonzero(wanted)
                        by, wanted = np.repeat(np.arange(len(q)), terms_of[q])[shared], wanted[shared]
                        score = np.stack([np.bincount(by, x[wanted], len(q)) for x in impacts])
                        where[words] = 0
                        k, q_at = np.nonzero((score > np.maximum(floors[q], 0.0)) & (ids[docs][:, None] != asked.qids[q]))
                        waiting.append((q[q_at], ids[docs[k]], score[k, q_at]))

        bar = bars()
        for batch in batches:
            for start in range(0, len(batch), READY):
                some = batch.slice(start, READY)
                term, first = _numbers(some.column("term"), np.uint64)
                tf, length, row = _numbers(some.column("tf"), np.int32)[0], some.column("length").to_numpy(), np.repeat(np.arange(len(some)), np.diff(first))
                term = places.of(term)
                known = np.flatnonzero(term >= 0)
                row, tf, term = row[known], tf[known], term[known]
                impact = asked.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[row] / max(mean_length, 1e-9)))
                meet(some.column("doc_id").to_numpy(), row, term, impact)
                if sum(len(x[0]) for x in waiting) > WAITING:
                    held, bar = kept(), bars()
        query, doc, score = kept()
        yield pa.RecordBatch.from_arrays([pa.array(asked.qids[query]), pa.array(doc), pa.array(score)], ["qid", "doc_id", "score"])

    return run


def _floor(score: np.ndarray) -> np.ndarray:
    """A bound under the k-th best score that its ties pass."""
    return score * (1 - 1e-9) - 1e-9


def top_k(documents: DataFrame, queries: DataFrame, n: int, mean_length: float, k: int = 10, block_queries: int = 50_000, block_terms: int = 2_000_000) -> DataFrame:
    """(qid, rank, doc_id, score): the exact k best documents of each query, but for the query's own rows.

    queries: (qid, word, term, df), stored. Blocks are cut by query id, so each holds about ``block_queries`` queries or ``block_terms`` rows.
    """
    spark = documents.sparkSession
    docs = documents.where("doc_id is not null").select("doc_id", "text").withColumn("pick", F.xxhash64("doc_id", "text"))
    size = queries.agg(F.count_distinct("qid").alias("queries"), F.count("*").alias("terms")).first()
    n_blocks = max(1, -(-size["queries"] // block_queries), -(-size["terms"] // block_terms))
    passes = -(-n_blocks // TOGETHER)
    rank = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "doc_id")
    share, shards, shares = 1, docs.rdd.getNumPartitions(), [1]
    while share < shards:
        share *= STEP
        shares.append(share)
    words, few, sample = None, None, docs
    if share > 1:
        words = stored(docs.mapInArrow(_words, "doc_id long, pick long, length long, term binary, tf binary"), "words")
        sample = stored(docs.where(F.pmod("pick", F.lit(share)) == 0).repartition(1), "sample")  # about one shard
    if share > STEP:  # what all steps but the last read
        few = stored(words.where(F.pmod("pick", F.lit(STEP)) == 0), "few")
    parts = []
    for number in range(passes):
        asked = _asked([_block(queries, n_blocks, b) for b in range(n_blocks * number // passes, n_blocks * (number + 1) // passes)], n)
        sent, floors = spark.sparkContext.broadcast(asked), asked.floors.copy()
        order = np.argsort(asked.qids)
        for share in reversed(shares):
            told = spark.sparkContext.broadcast(floors)
            if share == shares[-1]:
                some, search = sample.coalesce(1) if share > 1 else sample, _search(sent, mean_length, k)
            else:
                some, search = (few.where(F.pmod("pick", F.lit(share)) == 0) if share > 1 else words), _meet(sent, told, mean_length, k)
            found = some.mapInArrow(search, "qid long, doc_id long, score double").withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
            found = stored(found.select("qid", "rank", "doc_id", F.round("score", 9).alias("score")), "found")
            if share > 1:  # a number for each query of the pass
                last = found.where(F.col("rank") == k).select("qid", "score").toArrow()
                floors = floors.copy()
                floors[order[np.searchsorted(asked.qids, last["qid"].to_numpy(), sorter=order)]] = _floor(last["score"].to_numpy())
                drop(found)
            told.unpersist()
        sent.unpersist()
        parts.append(found)
    for x in (words, few, sample):
        drop(x)
    found = parts[0]
    for x in parts[1:]:
        found = found.union(x)
    return found


def _block(queries: DataFrame, n_blocks: int, block: int):
    """(query ids, number of terms of each, where each of these terms is among the block's terms, these, their df)."""
    rows = queries.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == block).select("qid", "term", "df").toArrow()
    qid, df_of, term_of = rows["qid"].to_numpy(), rows["df"].to_numpy(), rows["term"].to_numpy().view(np.uint64)
    order = np.lexsort((term_of, qid))
    terms, at = np.unique(term_of[order], return_inverse=True)
    df = np.zeros(len(terms))
    df[at] = df_of[order]
    qids, size = np.unique(qid, return_counts=True)
    return qids, size, at.astype(np.int32), terms, df


def _asked(blocks, n: int) -> Asked:
    """Several blocks' queries together, those that are alike beside each other."""
    qids, size, at, terms_of, df_of = zip(*blocks, strict=True)
    terms = np.unique(np.concatenate(terms_of))
    df = np.zeros(len(terms))
    for t, x in zip(terms_of, df_of, strict=True):
        df[np.searchsorted(terms, t)] = x
    asked = np.concatenate([np.searchsorted(terms, t).astype(np.int32)[x] for t, x in zip(terms_of, at, strict=True)])
    qids, size = np.concatenate(qids), np.concatenate(size)
    first = np.append(0, np.cumsum(size))
    order, cuts, merging = alike(first, asked, len(terms))
    return Asked(terms, np.log(1 + (n - df + 0.5) / (df + 0.5)), qids[order], np.append(0, np.cumsum(size[order])), asked[_ranges(first[order], first[order + 1])], np.full(len(qids), -1.0), cuts, merging)


def op7_search(spark, sf_dir: str) -> DataFrame:
    """Every 50th document asks for all its words."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    terms, n, mean_length = collection(documents)
    queries = stored(more_like(documents.where("doc_id % 50 = 0"), terms), "queries")
    found = top_k(documents, queries, n, mean_length)
    return found.select("qid", F.col("rank").cast("long").alias("rank"), "doc_id", F.round("score", 6).alias("score"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents WHERE doc_id IS NOT NULL),
t AS (SELECT r, doc_id, len(w) AS dl, unnest(w) AS word FROM d),
p AS (SELECT r, any_value(doc_id) AS doc_id, any_value(dl) AS dl, word, count(*) AS tf FROM t GROUP BY r, word),
s AS (SELECT count(*) AS n, CAST(sum(len(w)) AS DOUBLE) / count(*) AS mean FROM d),
f AS (SELECT word, count(*) AS df FROM p GROUP BY word),
q AS (SELECT DISTINCT p.doc_id AS qid, word, df FROM p JOIN f USING (word) WHERE df > 1 AND p.doc_id % 50 = 0),
x AS (SELECT qid, p.r, any_value(p.doc_id) AS doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score
      FROM q JOIN p USING (word) CROSS JOIN s WHERE p.doc_id <> qid GROUP BY qid, p.r),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM x)
SELECT qid, CAST(rank AS BIGINT) AS rank, doc_id, round(score, 6) AS score FROM k WHERE rank <= 10
"""
