"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed per Arrow slice with numpy; trees are fitted on a bounded sample of labelled rows
(``sample_rows``, those of the smallest id hash) and flattened into arrays that all documents traverse at once.

Edge cases: a null or empty text has all statistics 0 and is scored like any other; without labels of both classes
every score is the share of label 1 (0.5 without labels). Repeated rows are scored alike, row by row. Only the
requested columns leave the operator, so extra columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import held_out, label_sample, table, working_name

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digit", "punct", "symbol", "newline", "high", "distinct", "line_bytes", "line_copies", "short_words", "long_words", "upper_words", "marked_words", "ends", "pair_copies")


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars.encode())] = 1
    return out


_UPPER, _DIGIT = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("0123456789")
_PUNCT, _SYMBOL, _NEWLINE = _mask(".,;:!?'\"()-"), _mask("#$%&*@^~|<>{}[]\\/=_+`"), _mask("\n")
_HIGH = (np.arange(256) >= 0x80).astype(np.uint8)
_LINE = np.arange(256) != 0x0A


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct hashes of each document."""
    rows = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    keys = np.unique((rows << np.uint64(40)) | (hashes >> np.uint64(24)))
    return np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=len(first) - 1)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES per document of a slice."""
    size = np.diff(offsets)
    starts, ends, first = _text.word_bounds(data, offsets, _text.SPACE)
    words, length = np.diff(first), ends - starts
    running = _text.prefix_hash(data, _text.RAW_BYTE_HASH)
    hashes = _text.span_hash(running, starts, ends)
    line_start, line_end, line_first = _text.word_bounds(data, offsets, _LINE)
    lines = np.diff(line_first)
    per_byte, per_word, per_line = np.maximum(size, 1), np.maximum(words, 1), np.maximum(lines, 1)
    share = lambda mask: _text.segment_sum(mask[data], offsets) / per_byte
    word_share = lambda flag: _text.segment_sum(flag.astype(np.int64), first) / per_word
    second = data[np.minimum(starts + 1, max(len(data) - 1, 0))] if len(data) else data
    ends_in = data[ends - 1] if len(data) else data
    pairs = np.zeros(0, np.uint64)
    pair_first = np.zeros(len(first), np.int64)
    if len(hashes):
        joint = _text.mix(hashes[:-1] * np.uint64(3) + hashes[1:])
        inner = np.ones(len(joint), bool)
        cut = first[1:-1]
        inner[cut[(cut > 0) & (cut < len(hashes))] - 1] = False
        pairs, pair_first = joint[inner], np.concatenate([[0], np.cumsum(np.maximum(words - 1, 0))])
    return np.column_stack([
        np.log1p(size), np.log1p(words), _text.segment_sum(length, first) / per_word,
        share(_UPPER), share(_DIGIT), share(_PUNCT), share(_SYMBOL), share(_NEWLINE), share(_HIGH),
        _distinct(hashes, first) / per_word, size / per_line,
        (lines - _distinct(_text.span_hash(running, line_start, line_end), line_first)) / per_line,
        word_share(length <= 2), word_share(length >= 12), word_share((_UPPER[second] == 1) & (length >= 2)),
        word_share(_SYMBOL[ends_in] == 1), word_share(_PUNCT[ends_in] == 1),
        np.maximum(0, words - 1 - _distinct(pairs, pair_first)) / per_word,
    ])


@dataclass(frozen=True)
class Trees:
    """Complete binary trees as arrays: node i has children 2i+1 and 2i+2; a leaf's value is in ``leaf``."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x 2**depth

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1] if self.feature.ndim == 2 else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node[0] < inner if len(x) else False:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 5.0) -> Trees:
    """Newton boosting of the logistic loss on feature histograms."""
    nothing = np.zeros((0, 2**depth - 1))
    mean = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < mean < 1:
        return Trees({0.0: -40.0, 1.0: 40.0}.get(mean, 0.0), nothing.astype(np.int64), nothing, np.zeros((0, 2**depth)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    base = float(np.log(mean / (1 - mean)))
    margin, inner = np.full(len(y), base), 2**depth - 1
    feature, threshold, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            width = 2**level
            here = node - (width - 1)
            best, gain = np.zeros((width, 2)), np.full(width, 1e-6)
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                key, n = here * bins + binned[:, k], width * bins
                gl = np.bincount(key, g, n).reshape(width, bins).cumsum(1)
                hl = np.bincount(key, h, n).reshape(width, bins).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                value = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                value[(hl < 1) | (ht - hl < 1)] = 0
                value[:, len(c) :] = 0
                at = value.argmax(1)
                better = value[np.arange(width), at] > gain
                gain = np.where(better, value[np.arange(width), at], gain)
                best[better] = np.column_stack([np.full(width, k), c[np.minimum(at, len(c) - 1)]])[better]
            split = gain > 1e-6
            feature[t, width - 1 : 2 * width - 1] = best[:, 0]
            threshold[t, width - 1 : 2 * width - 1] = np.where(split, best[:, 1], np.inf)
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > threshold[t, node])
        at = node - inner
        leaf[t] = rate * np.bincount(at, g, inner + 1) / (np.bincount(at, h, inner + 1) + ridge)
        margin += leaf[t][at]
    return Trees(base, feature, threshold, leaf)


def _features_of(batches):
    for batch in batches:
        parts = [np.zeros((0, len(FEATURES)))] + [statistics(d, o) for _, _, d, o in _text.slices(batch.column("text"))]
        x = np.concatenate(parts)
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), values], ["doc_id", "label", "x"])


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = 20_000, modulus: int = 3) -> Trees:
    """Fit on at most ``sample_rows`` labelled documents, none of them held out. The sample's bound also bounds the join's small side."""
    sample = label_sample(labels, "quality", sample_rows, modulus)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")
    found = rows.mapInArrow(_features_of, "doc_id long, label int, x array<double>").orderBy("doc_id", F.xxhash64("x")).toPandas()
    x = np.stack(found["x"].to_numpy()) if len(found) else np.zeros((0, len(FEATURES)))
    return fit_trees(x, found["label"].to_numpy(float))


def scored(documents: DataFrame, model: Trees, column: str = "score") -> DataFrame:
    """All columns of documents and the score of each row; a column of the score's name is replaced."""
    kept = [f for f in documents.schema.fields if f.name != column]
    names = [f.name for f in kept]

    def run(batches):
        for batch in batches:
            out = np.concatenate([np.zeros(0)] + [model.score(statistics(d, o)) for _, _, d, o in _text.slices(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out)], [*names, column])

    schema = documents.select(*names).withColumn(column, F.lit(0.0)).schema
    return documents.mapInArrow(run, schema)


def keep_good(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier doesn't reject, with their columns."""
    name = working_name("quality_score", documents.columns)
    return scored(documents, fit(documents, labels), name).where(F.col(name) >= threshold).drop(name)


def op3_quality(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(documents, table(spark, sf_dir, "labels"))

    def digest(batches):
        for batch in batches:
            out = np.concatenate([np.zeros(0)] + [model.score(statistics(d, o)) for _, _, d, o in _text.slices(batch.column("text"))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out)], ["doc_id", "score"])

    found = documents.mapInArrow(digest, "doc_id long, score double")
    return found.select("doc_id", held_out(3).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
