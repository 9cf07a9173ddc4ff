"""Vectorised text helpers for Arrow batches: slices of whole documents, word bounds, 64-bit word hashes.

A null text counts as an empty one everywhere. A document is never cut: a slice holds whole documents, about
``limit`` bytes of them, or one longer document alone, so memory is bounded by the longest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.ones(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False  # words are [^\x20\x09-\x0D]+
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True  # words after lower-casing

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
_BYTE = np.random.default_rng(0x5EED).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_HASH = _BYTE[LOWER]  # folds A-Z
RAW_BYTE_HASH = _BYTE
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # of the first k bytes
_LENGTHS = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    y = x >> np.uint64(30)
    y ^= x
    y *= np.uint64(0xBF58476D1CE4E5B9)
    z = y >> np.uint64(27)
    y ^= z
    y *= np.uint64(0x94D049BB133111EB)
    z = np.right_shift(y, np.uint64(31), out=z) if np.ndim(z) else y >> np.uint64(31)
    y ^= z
    return y


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[name] = np.cumprod(x, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def slices(column: pa.Array, limit: int = 1 << 20):
    """Yield (first row, last row, bytes, offsets) of runs of whole texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the index of each document's first word (one more entry at the end)."""
    inside = table[data]
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]
    before[first] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix_hash(data: np.ndarray, table: np.ndarray = BYTE_HASH) -> np.ndarray:
    """Running polynomial sums; span_hash() makes hashes of byte spans from them."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * powers(len(data))[0], out=out[1:])
    return out


def span_hash(running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix((running[ends] - running[starts]) * powers(len(running))[1][starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hash(prefix_hash(data), starts, ends)


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 64) -> np.ndarray:
    """Other hashes of words, A-Z folded, eight bytes at a time: their work goes with the words. Words of more than ``most`` bytes keep word_hashes()."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = LOWER[data]
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    length = ends - starts
    out = mix(np.arange(_LENGTHS, dtype=np.uint64))[length] if not len(length) or length.max() < _LENGTHS else mix(length.astype(np.uint64))
    first = eight[starts]
    first &= _MASK[np.minimum(length, 8)]
    first *= np.uint64(_BASE)
    out ^= first
    out = mix(out)
    k, done = np.flatnonzero((length > 8) & (length <= most)), 8
    while len(k):
        out[k] = mix(out[k] ^ (eight[starts[k] + done] & _MASK[np.minimum(length[k] - done, 8)]) * np.uint64(_BASE))
        done += 8
        k = k[length[k] > done]
    k = np.flatnonzero(length > most)
    if len(k):
        out[k] = word_hashes(data, starts[k], ends[k])
    return out


def order_of(hashes: np.ndarray) -> np.ndarray:
    """A stable argsort of hashes: their upper bits are sorted with the row numbers in the lower ones, which is several times as fast."""
    bits = np.uint64(max(len(hashes) - 1, 1).bit_length())
    packed = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).view(np.int64)
    ranked = hashes[order]
    return np.argsort(hashes, kind="stable") if (ranked[1:] < ranked[:-1]).any() else order


def uniques(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted different hashes, and where each given one is among them."""
    order = order_of(hashes)
    ranked = hashes[order]
    new = np.ones(len(ranked), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    at = np.empty(len(ranked), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


class Places:
    """Where values stand among sorted different hashes: a hash's upper bits lead to the few that share them."""

    def __init__(self, keys: np.ndarray):
        bits = len(keys).bit_length() + 1
        self.keys, self.shift = keys, np.uint64(64 - bits)
        self.first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount((keys >> self.shift).astype(np.int64), minlength=1 << bits), out=self.first[1:])

    def of(self, values: np.ndarray) -> np.ndarray:
        """Index of each value, or -1."""
        slot = (values >> self.shift).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(values), -1, np.int64)
        left = np.flatnonzero(at < end)
        while len(left):
            here = at[left]
            hit = self.keys[here] == values[left]
            out[left[hit]] = here[hit]
            at[left] += 1
            left = left[~hit & (here + 1 < end[left])]
        return out


def hash_words(words: list[str], table: np.ndarray = ALNUM) -> np.ndarray:
    """The hashes that word_hashes() gives these words."""
    column = pa.array(words, pa.large_string())
    out = np.zeros(len(words), np.uint64)
    for i, j, data, offsets in slices(column):
        out[i:j] = span_hash(prefix_hash(data), offsets[:-1], offsets[1:])
    return out


def lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Index of each value in the sorted keys, or -1."""
    if not len(keys):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(keys, values)
    at[at == len(keys)] = 0
    return np.where(keys[at] == values, at, -1)


def segment_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for each i; empty segments give 0."""
    total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
