"""Vectorised text handling on flat byte arrays: token spans and 64-bit hashes of them, no loop over words."""

from __future__ import annotations

import numpy as np

U = np.uint64
_SEED = np.random.default_rng(0x5EED)
#: A random 64-bit value for each byte value, and the odd step between places in a word.
BYTE = _SEED.integers(0, 1 << 64, 256, dtype=U)
STEP = U(0x9E3779B97F4A7C15)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = np.asarray(h, U)
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the non-empty spans [start, end) of 64-bit values.

    Each value is mixed with its place in the span before the sum is taken, so that no two places share a factor: a sum of
    powers modulo 2**64 gives words such as Thue and Morse's and their complements the same hash, whatever its base.
    """
    size = end - start
    if not len(size):
        return np.zeros(0, U)
    place = ragged(size)
    v = place.astype(U)
    v *= STEP
    place += np.repeat(start, size)
    v += values[place]
    return mix(np.add.reduceat(mix(v), np.cumsum(size) - size) + size.astype(U))


def spans(inside: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of maximal runs of True that no row offset cuts through."""
    n = len(inside)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = rows[(rows > 0) & (rows < n)]
    first[cut] |= inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] |= inside[cut - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(rows, start, "right") - 1


def words(buf: np.ndarray, rows: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the white-space separated words of a flat UTF-8 buffer; A-Z are lowered if asked."""
    buf = LOWER[buf] if lower else buf
    start, end, row = spans(~SPACE[buf], rows)
    return span_hash(BYTE[buf], start, end), row


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, end to end."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
