"""Whole columns of text as bytes: words, their hashes and shingles, computed for many rows at once."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
TOKEN = np.zeros(256, bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Ranges are hashed modulo this prime: modulo a power of two, some words collide whatever the base (Thue-Morse sequences).
PRIME = (1 << 61) - 1
ROOT = int(np.random.default_rng(20240501).integers(1 << 60, PRIME))
PIECE, RUN = 1 << 17, 1 << 15
_P, _LOW = np.uint64(PRIME), np.uint64((1 << 31) - 1)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty."""
    filled = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = filled.buffers()
    ends = np.frombuffer(offsets, np.int64)[filled.offset:filled.offset + len(filled) + 1] if len(filled) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), ends


def blocks(column: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole rows of about ``limit`` bytes: first row, end row, bytes, offsets from 0."""
    data, ends = raw(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + limit, "right")) - 1)
        yield first, last, data[ends[first]:ends[last]], ends[first:last + 1] - ends[first]
        first = last


def _reduce(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from halves of 31 and 30 bits so that no sum passes 64 bits."""
    a1, a0, b1, b0 = a >> np.uint64(31), a & _LOW, b >> np.uint64(31), b & _LOW
    middle = a1 * b0 + a0 * b1
    low = ((middle & np.uint64((1 << 30) - 1)) << np.uint64(31)) + (middle >> np.uint64(30))
    return _reduce(np.uint64(2) * a1 * b1 + low + a0 * b0)


@functools.lru_cache(maxsize=8)
def _powers(bits: int, base: int) -> np.ndarray:
    """Powers 0 to 2**bits - 1 of a base modulo the prime."""
    made = np.ones(1, np.uint64)
    for k in range(bits):
        made = np.concatenate([made, _times(made, np.full(1, pow(base, 1 << k, PRIME), np.uint64))])
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _bounds(inside: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(inside):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[ends[:-1][ends[:-1] < len(inside)]] = False
        after[ends[1:][ends[1:] > 0] - 1] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, ends)


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row (and the end) its first word."""
    return _bounds(~SPACE[data], ends)


def token_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z lower-cased, and the bounds of runs of letters and digits (every byte beyond ASCII counts)."""
    return LOWER[data], *_bounds(TOKEN[data], ends)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums modulo the prime of the bytes (plus one) times powers of a root."""
    sums = np.zeros(len(data) + 1, np.uint64)
    powers = _powers(max(21, len(data).bit_length()), ROOT)
    for first in range(0, len(data), PIECE):
        bytes_ = data[first:first + PIECE].astype(np.uint64) + np.uint64(1)
        power = powers[first:first + len(bytes_)]
        high, low = np.cumsum(bytes_ * (power >> np.uint64(31))), np.cumsum(bytes_ * (power & _LOW))
        high = ((high & np.uint64((1 << 30) - 1)) << np.uint64(31)) + (high >> np.uint64(30))
        sums[first + 1:first + len(bytes_) + 1] = _reduce(high + low + sums[first])
    return sums


def range_hashes(sums: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each range of bytes."""
    back = _powers(max(21, (len(sums) - 1).bit_length()), pow(ROOT, -1, PRIME))
    made = np.empty(len(starts), np.uint64)
    for first in range(0, len(starts), RUN):  # short runs stay in the processor's cache
        begin, end = starts[first:first + RUN], stops[first:first + RUN]
        value = _times(_reduce(sums[end] + _P - sums[begin]), back[begin])
        made[first:first + RUN] = mix(value + (end - begin).astype(np.uint64) * BASE)
    return made


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words in order, and each row's first one.

    A row of fewer words, but one at least, has its whole sequence as its only shingle.
    """
    counts = np.diff(first)
    full = np.maximum(counts - size + 1, 0)
    made = np.where(counts > 0, np.maximum(full, 1), 0)
    bounds = np.concatenate(([0], np.cumsum(made)))
    rows = np.repeat(np.arange(len(counts)), made)
    at = first[rows] + np.arange(len(rows)) - bounds[rows]
    total = np.zeros(len(rows), np.uint64)
    width = np.minimum(counts, size)[rows]
    for k in range(size):
        has = k < width
        total += np.where(has, words[np.minimum(at + k, max(len(words) - 1, 0))], 0).astype(np.uint64) * (BASE ** np.uint64(2 * k + 1)) if len(words) else 0
        total = mix(total + np.uint64(k + 1) * has.astype(np.uint64))
    return total, bounds
