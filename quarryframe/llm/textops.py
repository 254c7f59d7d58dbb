"""Vectorised words, shingles and counts over batches of UTF-8 texts."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: The separators of words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: What is no part of a bare word: every ASCII byte but letters and digits.
NOT_BARE = np.ones(256, bool)
NOT_BARE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, _U), np.ones(1, _U))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        up, down = np.full(size, _BASE, _U), np.full(size, _BASE_INVERSE, _U)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size > 1 << 22:  # one very long text: don't keep its tables
            out, _powers = _powers, (np.ones(1, _U), np.ones(1, _U))
            return out
    return _powers


def word_bounds(data: np.ndarray, offs: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and text index of the words; no word spans two texts."""
    inside = ~separators[data]
    n = len(data)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offs[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for every span."""
    n = len(data)
    if len(starts) == 0:
        return np.zeros(0, _U)
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


def shingles(words: np.ndarray, owner: np.ndarray, count: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of n words in a text, and their text index.

    words, owner: word hashes in order and their text; count: texts.  A text with 1 to n-1 words has
    its whole sequence as its one shingle; one without words has none.
    """
    per = np.bincount(owner, minlength=count)
    m = len(words)
    factors = [mix(np.array([k + 1], _U) * _U(_BASE))[0] | _U(1) for k in range(n)]
    if m >= n:
        total = np.zeros(m - n + 1, _U)
        for k in range(n):
            total += words[k : m - n + 1 + k] * factors[k]
        full = owner[: m - n + 1] == owner[n - 1 :]
        hashes, owners = mix(total[full] + _U(n)), owner[: m - n + 1][full]
    else:
        hashes, owners = np.zeros(0, _U), np.zeros(0, owner.dtype)
    short = np.flatnonzero((per > 0) & (per < n))
    if len(short):
        firsts = np.concatenate([[0], np.cumsum(per)[:-1]])[short]
        total = np.zeros(len(short), _U)
        for k in range(n - 1):
            has = per[short] > k
            total[has] += words[firsts[has] + k] * factors[k]
        hashes = np.concatenate([hashes, mix(total + per[short].astype(_U))])
        owners = np.concatenate([owners, short])
        order = np.argsort(owners, kind="stable")
        hashes, owners = hashes[order], owners[order]
    return hashes, owners


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> list[np.ndarray]:
    """For every text the sorted distinct hashes of its n-word shingles, A-Z lower-cased."""
    count = len(offs) - 1
    low = LOWER[data]
    starts, ends, owner = word_bounds(low, offs)
    hashes, owners = shingles(span_hashes(low, starts, ends), owner, count, n)
    cuts = np.searchsorted(owners, np.arange(count + 1))
    return [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of all spans, one after the other."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)
