"""Vectorised words, hashes and shingles over UTF-8 bytes.

Words are runs of bytes other than 0x20 and 0x09-0x0D; all those separators
are ASCII, so cutting bytes never cuts a code point.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (wraps)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of several texts in a row: byte ranges, and ``ptr[d]:ptr[d+1]`` are text d's."""
    start: np.ndarray
    end: np.ndarray
    ptr: np.ndarray


def find_words(buf: np.ndarray, off: np.ndarray) -> Words:
    if len(buf) == 0:
        return Words(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64))
    inside = ~SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = off[(off > 0) & (off < len(buf))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(first)
    return Words(start, np.flatnonzero(last) + 1, np.searchsorted(start, off))


def hash_ranges(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; ranges are disjoint and in order."""
    if len(start) == 0:
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.arange(int(size.sum()), dtype=np.int64)
    first = np.cumsum(size) - size
    at -= np.repeat(first, size)
    raw = buf if len(at) == len(buf) else buf[at + np.repeat(start, size)]  # ranges may fill it
    v = _BYTE[raw] * _STEP[at & 4095]
    if int(size.max()) > 4096:
        v = v * (np.uint64(2) * (at >> 12).astype(np.uint64) + np.uint64(1))
    return mix(np.add.reduceat(v, first) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hash(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + h[k:k + n] + np.uint64(k + 1))
    return out


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text; fewer words make one shingle."""
    if len(h) == 0:
        return h
    return np.unique(window_hash(h, min(width, len(h))) + np.uint64(0 if len(h) >= width else len(h)))
