"""Vectorised hashing of slices of an array: many words or tokens at once, without a Python loop."""

from __future__ import annotations

import functools

import numpy as np

_BASE = 0x9E3779B97F4A7C13  # odd, 3 mod 8
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


@functools.lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(1 << max(20, int(n).bit_length()))


def slices(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of units[start:end], equal for equal slices; ``units`` holds 64-bit values already mixed."""
    up, down = powers(len(units) + 1)
    total = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * up[: len(units)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@functools.lru_cache(maxsize=4)
def byte_units(lower: bool) -> np.ndarray:
    """A mixed value for each byte; with ``lower``, A-Z as a-z."""
    b = np.arange(256, dtype=np.uint64)
    if lower:
        b[65:91] += np.uint64(32)
    return mix(b + np.uint64(0x1234567))


@functools.lru_cache(maxsize=1)
def _spaces() -> np.ndarray:
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


def word_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (no space, tab or line end) of texts that lie in ``data`` at ``offs``;
    and for each text the index of its first word, with the number of words at the end."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~_spaces()[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    edge = edge[:-1]
    prev = np.empty_like(word)
    prev[0] = False
    prev[1:] = word[:-1]
    starts = np.flatnonzero(word & (~prev | edge))
    last = np.empty_like(word)
    last[-1] = True
    last[:-1] = ~word[1:] | edge[1:]
    ends = np.flatnonzero(word & last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return slices(byte_units(True)[data], starts, ends)


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """flat[start : start + count] of each pair, one after another."""
    ends = np.cumsum(counts, dtype=np.int64)
    return flat[np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)]
