"""Gibbs sampling of the tables of Pitman-Yor restaurants.

A dish with c customers has t tables with a probability in proportion to S(c, t) * base**t * prod(strength + discount *
(others + i), i < t), where S are the generalised Stirling numbers and ``others`` the tables of the other dishes.
Dishes of up to ``EXACT`` customers are drawn from this law by enumeration; larger ones take Metropolis steps that leave
the same law unchanged. S(c, t) = c! / (t! d**t) P(X1 + .. + Xt = c) for independent Sibuya(d) variables, which an
alternating series gives for few tables and a saddle point for many; at ``EXACT`` both agree with the recursion.
"""

from __future__ import annotations

import numpy as np

from . import _text

EXACT = 512
_NEGATIVE = -1e300
_SCALES = (1, 4, 16, 64, 256, 1024) * 6
_STIRLING: dict[float, np.ndarray] = {}
_NARROW = 16
_BAND = np.floor(np.log2(np.maximum(np.arange(EXACT + 1), 1)) * 4)
_SADDLE_STEPS = 6


def log_stirling(discount: float, most: int = EXACT) -> np.ndarray:
    """ln of the generalised Stirling numbers by recursion: S(c+1, t) = S(c, t-1) + (c - t d) S(c, t)."""
    out = np.full((most + 1, most + 1), _NEGATIVE)
    out[0, 0] = 0.0
    for c in range(most):
        t = np.arange(1, c + 2)
        stay = np.where(c - t * discount > 0, np.log(np.maximum(c - t * discount, 1e-300)) + out[c, t], _NEGATIVE)
        out[c + 1, t] = np.logaddexp(out[c, t - 1], stay)
    return out


def _table(discount: float) -> np.ndarray:
    if discount not in _STIRLING:
        if len(_STIRLING) > 1:  # a fit has two: the contexts' and the parent's
            _STIRLING.clear()
        _STIRLING[discount] = log_stirling(discount)
    return _STIRLING[discount]


def log_gamma(x) -> np.ndarray:
    """ln of the gamma function of positive numbers (Stirling's series after eight steps of the recursion)."""
    x = np.asarray(x, float)
    low = np.ones_like(x)
    for k in range(8):
        low = low * (x + k)
    return _log_gamma_series(x + 8) - np.log(low)


def _log_gamma_series(y: np.ndarray) -> np.ndarray:
    back = 1 / y
    square = back * back
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + back * (1 / 12 - square * (1 / 360 - square / 1260))


def log_stirling_at(customers: np.ndarray, tables: np.ndarray, discount: float, terms: int = 48) -> np.ndarray:
    """ln S(c, t) for many customers, up to a term that depends on c alone."""
    c, t, d = np.asarray(customers, float), np.asarray(tables, float), discount
    out = -log_gamma(t + 1) - t * np.log(d)
    few = t <= (2.3 - 2 * d) * c**d
    told = np.empty_like(out)
    if few.any():
        a, b, j = c[few, None], t[few, None], np.arange(1, terms + 1)
        there = j <= b
        chosen = np.log(np.where(there, b - j + 1, 1.0)).cumsum(1)  # ln of b! / (b - j)!
        rest = _log_gamma_series(a - j * d) if c.min() > EXACT else log_gamma(np.maximum(a - j * d, 1e-3))  # the series needs no recursion there
        size = chosen - log_gamma(j + 1) + log_gamma(j * d + 1) + rest - log_gamma(a + 1)
        value = np.where(there, np.exp(size - size[:, :1]) * np.sin(np.pi * j * d) * np.where(j % 2, 1.0, -1.0), 0.0).sum(1) / np.pi
        told[few] = np.log(np.maximum(value, 1e-300)) + size[:, 0]
    if not few.all():
        told[~few] = _saddle(c[~few], t[~few], d)
    return out + told


def _saddle(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """ln P(X1 + .. + Xt = c) at the saddle point s of the Sibuya generating function 1 - (1 - s)**d."""
    every = t >= c
    m = np.where(every, 2.0, c / np.minimum(t, c - 1))
    # Newton's steps for x, the logit of s, on ln(tilted mean - 1), which is concave: they rise from the larger root of its asymptotes
    x = np.maximum(np.log(2 * (m - 1) / (1 - d)), np.log((m - 1) / d) / (1 - d))
    for _ in range(_SADDLE_STEPS):
        rest, odds = -np.logaddexp(0, x), np.exp(x)
        mean = np.exp(x + d * rest) * d / -np.expm1(d * rest)
        more = np.maximum(mean - 1, 1e-16)
        x = x - np.log(more / (m - 1)) * more / np.maximum(mean * (1 + (1 - d) * odds - mean) * np.exp(rest), 1e-16)
    rest = -np.logaddexp(0, x)  # ln(1 - s)
    spread = np.maximum(m * (1 + (1 - d) * np.exp(x) - m), 1e-12)
    out = t * np.log(-np.expm1(d * rest)) + c * np.logaddexp(0, -x) - 0.5 * np.log(2 * np.pi * t * spread)
    return np.where(every, c * np.log(d), out)


def uniform(seeds: np.ndarray, k) -> np.ndarray:
    """The k-th number in (0, 1) of each seed."""
    x = _text.mix(seeds + (np.atleast_1d(np.asarray(k, np.uint64)) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return ((x >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def seeds_of(rng, n: int) -> np.ndarray:
    """A generator's seeds for n dishes, or the given ones."""
    return rng.integers(0, 1 << 63, n).astype(np.uint64) if isinstance(rng, np.random.Generator) else rng


def draw(customers: np.ndarray, tables: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float, rng) -> np.ndarray:
    """New table counts of dishes, each given the tables of the others in its restaurant.

    rng: a generator, or a seed for each dish; then a dish's draw doesn't hang on what stands beside it.
    """
    seeds = seeds_of(rng, len(customers))
    out, share = tables.copy(), np.maximum(base, 1e-300)
    base = np.log(share)
    out[customers <= 1] = customers[customers <= 1]
    order = np.argsort(np.minimum(customers, EXACT + 1).astype(np.uint16), kind="stable")  # such are sorted by radix
    ranked = customers[order]
    small = order[(ranked > 1) & (ranked <= EXACT)]
    if len(small):
        stirling, sizes = _table(discount), customers[small]
        band = _BAND[sizes]  # sizes within a fifth are drawn together; beyond its own size a dish has no weight
        cut = np.flatnonzero(np.concatenate([[True], band[1:] != band[:-1]]))
        for at, end in zip(cut.tolist(), [*cut[1:].tolist(), len(small)], strict=True):
            c = int(sizes[end - 1])
            if c <= _NARROW:
                more = np.exp(np.diff(stirling[: c + 1, 1 : c + 1]))  # 0 where there would be more tables than customers
                for a in range(at, end, 1 << 14):
                    k = small[a : min(a + (1 << 14), end)]
                    own = c if sizes[at] == c else sizes[a : a + len(k)]
                    out[k] = _narrow(c, more, own, others[k], share[k], discount, strength, seeds[k])
                continue
            t, step = np.arange(1, c + 1), max(1, 1_000_000 // c)
            for a in range(at, end, step):
                k, own = small[a : min(a + step, end)], sizes[a : min(a + step, end)]
                opening = np.log(np.maximum(strength + discount * (others[k][:, None] + t - 1), 1e-300)).cumsum(1)
                weight = stirling[own[:, None], t] + t * base[k][:, None] + opening
                out[k] = 1 + (weight - np.log(-np.log(uniform(seeds[k][:, None], t)))).argmax(1)
    large = order[ranked > EXACT]
    for k in (large[a : a + 20_000] for a in range(0, len(large), 20_000)):
        out[k] = _metropolis(customers[k], np.maximum(out[k], 1), others[k], base[k], discount, strength, seeds[k])
    return out


def _narrow(c, more, own, others, base, d, strength, seeds):
    """draw()'s choice among up to c tables by products, as the first of exponential waiting times; one number of tables after another for all dishes."""
    out, best, chance = np.ones(len(seeds), np.int64), -np.log(uniform(seeds, 1)), 1.0
    for t in range(2, c + 1):
        chance = chance * (more[own, t - 2] * base * np.maximum(strength + d * (others + (t - 1)), 1e-300))
        with np.errstate(divide="ignore"):
            wait = -np.log(uniform(seeds, t)) / chance
        np.copyto(out, t, where=wait < best)
        best = np.minimum(wait, best)
    return out


def _metropolis(c, t, others, base, d, strength, seeds):
    weight = lambda t: log_stirling_at(c, t, d) + t * (base + np.log(d)) + log_gamma(np.maximum(strength / d + others, 1e-9) + t)
    now = weight(t)
    for step, scale in enumerate(_SCALES):
        up, far, chance = (uniform(seeds, 3 * step + k) for k in range(3))
        move = t + np.where(up < 0.5, -1, 1) * (1 + (far * scale).astype(np.int64))
        inside = (move >= 1) & (move <= c)
        then = weight(np.where(inside, move, t))
        take = inside & (np.log(chance) < then - now)
        t, now = np.where(take, move, t), np.where(take, then, now)
    return t


def sweep(restaurant: np.ndarray, customers: np.ndarray, tables: np.ndarray, totals: np.ndarray, base: np.ndarray, discount: float, strength: float, rng, blocks: int = 16) -> np.ndarray:
    """One pass over the dishes of many restaurants; ``restaurant`` ascends from 0, ``totals`` are their tables at the start.

    The n-th dishes of all restaurants are drawn at once, so a restaurant's dishes are drawn one after another. One of more
    than ``blocks`` dishes is drawn in that many parts, each from totals in which its own part's moves are still missing; its
    dishes of more than ``EXACT`` customers are a part of their own, the last.
    """
    tables, totals, seeds = tables.copy(), totals.astype(float).copy(), seeds_of(rng, len(customers))
    first = np.searchsorted(restaurant, np.arange(len(totals)))
    turn = (np.arange(len(restaurant)) - first[restaurant]) % blocks
    turn[customers > EXACT] = blocks
    turn[customers <= 1] = blocks + 1
    order = np.argsort(turn.astype(np.uint8 if blocks < 255 else np.int64), kind="stable")
    cut = np.searchsorted(turn[order], np.arange(blocks + 2))
    for k in (order[a:b] for a, b in zip(cut, cut[1:], strict=False)):
        if not len(k):
            continue
        new = draw(customers[k], tables[k], totals[restaurant[k]] - tables[k], base[k], discount, strength, seeds[k])
        totals += np.bincount(restaurant[k], new - tables[k], len(totals))
        tables[k] = new
    return tables
