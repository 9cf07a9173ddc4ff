"""Toxicity by maximum-scoring segments.

Token log-odds with an informative Dirichlet prior (the pooled counts) are learned from a bounded sample of labelled
rows. A linear-time scan finds every maximal-scoring segment of a document; a Karlin-Altschul extreme-value fit turns
segment scores into E-values, and a logistic calibration on the sample turns the best segments' values into a score.

Edge cases: a null or empty text has no segment and gets the score of a text without evidence; without labels of both
classes nothing is significant and all scores are the share of label 1 (0 without labels). Repeated rows are scored
alike, and equal scores are equal evidence, so ties need no rule. Only the named columns are read, so extra columns can't
clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text
from ._store import drop, held_out, label_sample, stored, table

PRIOR_TEXTS = 5


@dataclass(frozen=True)
class Lexicon:
    keys: np.ndarray  # sorted word hashes of the tokens with evidence of their own
    odds: np.ndarray
    rest: float  # log-odds of every other token
    rate: float = 1.0  # lambda of the extreme-value distribution
    log_k: float = 0.0
    slope: float = 0.0
    intercept: float = -30.0

    def values(self, hashes: np.ndarray) -> np.ndarray:
        at = _text.lookup(self.keys, hashes)
        return np.where(at >= 0, self.odds[at] if len(self.odds) else 0.0, self.rest)


def maximal_segments(values: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, end, sum), left to right, in linear time.

    Runs of non-positive values only matter by their sum, so the scan visits positive values alone.
    """
    at = np.flatnonzero(values > 0)
    if not len(at):
        return []
    running = np.concatenate([[0.0], np.cumsum(values)])
    found: list[list] = []  # first, end, sum before, sum after, index of the last one with a smaller sum before
    for i in at.tolist():
        item = [i, i + 1, running[i], running[i + 1], -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j = found[j][4]
            if j < 0 or found[j][3] >= item[3]:
                item[4] = j
                found.append(item)
                break
            item = [found[j][0], item[1], found[j][2], item[3], -1]
            del found[j:]
    return [(a, b, float(y - x)) for a, b, x, y, _ in found]


def _evidence(model: Lexicon, data: np.ndarray, offsets: np.ndarray):
    """For each document of a slice: its number of words and its maximal segments (by word index)."""
    starts, ends, first = _text.word_bounds(data, offsets, _text.ALNUM)
    values = model.values(_text.word_hashes(data, starts, ends))
    busy = np.add.reduceat(np.append(values > 0, False), first[:-1]) if len(first) > 1 else []
    for k in range(len(first) - 1):
        own = values[first[k] : first[k + 1]]
        yield len(own), (maximal_segments(own) if len(own) and busy[k] else []), starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]]


def _normal(model: Lexicon, n: int, segments: list) -> float:
    """lambda * S - ln(K n) summed over the segments that alone are unlikely by chance; 0 without any."""
    chance = model.log_k + np.log(max(n, 1))
    return float(sum(max(0.0, model.rate * s - chance) for _, _, s in segments))


_COUNTS = ("word", "toxic", "clean", "toxic_docs", "clean_docs")


def _token_counts(batches):
    for batch in batches:
        labels = batch.column("label").to_numpy(zero_copy_only=False)
        for i, _, data, offsets in _text.slices(batch.column("text")):
            starts, ends, first = _text.word_bounds(data, offsets, _text.ALNUM)
            hashes = _text.word_hashes(data, starts, ends)
            toxic = np.repeat(labels[i : i + len(first) - 1] == 1, np.diff(first))
            keys, at = np.unique(hashes, return_inverse=True)
            row = np.repeat(np.arange(len(first) - 1), np.diff(first))
            once = np.unique(row * len(keys) + at, return_index=True)[1]
            counts = []
            for own, flag in ((at, toxic), (at[once], toxic[once])):  # occurrences, then documents
                bad = np.bincount(own, flag, len(keys)).astype(np.int64)
                counts += [bad, np.bincount(own, minlength=len(keys)) - bad]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, counts)], list(_COUNTS))


def fit(documents: DataFrame, labels: DataFrame, sample_rows: int = 20_000, prior: float = 0.05, least_z: float = 3.0, least_odds: float = 1.5, modulus: int = 3) -> Lexicon:
    """Learn from at most ``sample_rows`` labelled documents; ``prior`` is the weight of the pooled Dirichlet prior as a share of the sample's tokens. Exact copies in the sample count once."""
    sample = label_sample(labels, "toxic", sample_rows, modulus)
    rows = documents.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text").dropDuplicates(["text", "label"])
    rows = stored(rows, "toxicity-sample")  # read three times
    counts = rows.mapInArrow(_token_counts, ", ".join(f"{c} long" for c in _COUNTS)).groupBy("word").agg(*(F.sum(c).alias(c) for c in _COUNTS[1:]))
    n = counts.agg(*(F.sum(c).alias(c) for c in _COUNTS[1:])).first()
    if not n or not n["toxic"] or not n["clean"]:
        share = rows.agg(F.avg("label")).first()[0] or 0.0
        drop(rows)
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0), -1.0, intercept=float(np.log(max(share, 1e-13)) - np.log(max(1 - share, 1e-13))))
    total = n["toxic_docs"] + n["clean_docs"]
    a = prior * (F.col("toxic_docs") + F.col("clean_docs"))
    bad, good = F.col("toxic_docs") + a, F.col("clean_docs") + a
    odds = F.log(bad / (n["toxic_docs"] + prior * total - bad)) - F.log(good / (n["clean_docs"] + prior * total - good))
    # evidence of its own: least_z standard deviations above chance and odds that matter; the sample's bound bounds their number
    found = counts.where((odds >= least_odds) & (odds / F.sqrt(1 / bad + 1 / good) >= least_z)).orderBy("word").toPandas()
    keys = found["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    p, q = found["toxic"].sum() / n["toxic"], found["clean"].sum() / n["clean"]
    rest = float(np.log(max(1 - p, 1e-9)) - np.log(max(1 - q, 1e-9)))
    # the scores that segments sum up: log-odds under a Dirichlet prior of the pooled counts, worth a share of the sample's tokens
    pooled = prior * (found["toxic"] + found["clean"]).to_numpy(float)
    worth = prior * (n["toxic"] + n["clean"])
    odds_of = np.log((found["toxic"].to_numpy(float) + pooled) / (n["toxic"] + worth)) - np.log((found["clean"].to_numpy(float) + pooled) / (n["clean"] + worth))
    model = Lexicon(keys[order], np.maximum(odds_of, 0.1)[order], min(rest, -1e-3))
    share = ((found["clean"] + 0.5) / n["clean"]).to_numpy(float)[order]

    def excess(rate):
        return float((share * np.exp(rate * model.odds)).sum() + (1 - share.sum()) * np.exp(rate * model.rest) - 1)

    low, high = 1e-3, 20.0
    for _ in range(60):  # the positive root of sum p exp(lambda s) = 1
        mid = (low + high) / 2
        low, high = (low, mid) if excess(mid) > 0 else (mid, high)
    model = Lexicon(model.keys, model.odds, model.rest, max(low, 1e-2))

    def best(batches, model=model):
        for batch in batches:
            n_words, peak = [], []
            for _, _, data, offsets in _text.slices(batch.column("text")):
                for n, segments, _, _ in _evidence(model, data, offsets):
                    n_words.append(n)
                    peak.append([s for _, _, s in segments])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(n_words, pa.int64()), pa.array(peak, pa.list_(pa.float64()))], ["doc_id", "label", "n", "peaks"])

    peaks = rows.mapInArrow(best, "doc_id long, label int, n long, peaks array<double>").orderBy("doc_id", "n").toPandas()
    y, n_words = peaks["label"].to_numpy(float), np.maximum(peaks["n"].to_numpy(float), 1)
    top = np.array([max(x, default=0.0) for x in peaks["peaks"]])
    clean = (y == 0) & (top > 0)
    drop(rows)
    # the mean of a Gumbel law is (ln(K n) + gamma) / lambda; texts without any segment are below its support. A sample's
    # mean is drawn toward K n = 1 for a text of mean length, by as much as ``PRIOR_TEXTS`` texts
    told = (model.rate * top[clean] - np.log(n_words[clean]) - 0.5772).sum()
    log_k = float((told - PRIOR_TEXTS * np.log(n_words.mean())) / (clean.sum() + PRIOR_TEXTS))
    model = Lexicon(model.keys, model.odds, model.rest, model.rate, log_k)
    x = np.array([_normal(model, n, [(0, 0, s) for s in own]) for n, own in zip(n_words, peaks["peaks"], strict=True)])
    slope, intercept = _logistic(np.log1p(x), y)
    return Lexicon(model.keys, model.odds, model.rest, model.rate, log_k, slope, intercept)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, float]:
    """Newton steps for a one-feature logistic regression."""
    w, design = np.zeros(2), np.column_stack([x, np.ones(len(x))])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        g = design.T @ (y - p) - ridge * w
        h = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, g), -5, 5)
    return float(max(w[0], 0.0)), float(w[1])


def score_of(model: Lexicon, n: int, segments: list) -> float:
    z = model.slope * np.log1p(_normal(model, n, segments)) + model.intercept
    return float(1 / (1 + np.exp(-min(max(z, -30), 30))))


def passages(documents: DataFrame, model: Lexicon, most_expected: float = 0.05) -> DataFrame:
    """doc_id, n_words, score and every passage whose E-value is at most ``most_expected``: (first and end character, first and end word, score, E-value)."""

    def run(batches):
        for batch in batches:
            n_words, scores, spans = [], [], []
            for _, _, data, offsets in _text.slices(batch.column("text")):
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                for k, (n, segments, starts, ends) in enumerate(_evidence(model, data, offsets)):
                    n_words.append(n)
                    scores.append(score_of(model, n, segments))
                    own = []
                    for a, b, s in segments:
                        expected = float(np.exp(min(model.log_k + np.log(max(n, 1)) - model.rate * s, 700.0)))
                        if expected <= most_expected:
                            zero = chars[offsets[k]]
                            own.append({"start": int(chars[starts[a]] - zero), "end": int(chars[ends[b - 1]] - zero), "first_word": a, "end_word": b, "score": s, "expected": expected})
                    spans.append(own)
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "n_words", "score", "passages"])

    schema = "doc_id long, n_words long, score double, passages array<struct<start:long,end:long,first_word:long,end_word:long,score:double,expected:double>>"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = passages(documents, fit(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(3).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"))
