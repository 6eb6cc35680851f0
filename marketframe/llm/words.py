"""Words and word shingles of many texts at once, as 64-bit hashes in numpy.

A word is a run of bytes that are neither a space nor 0x09-0x0D, with A-Z lowered.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

#: Words longer than this are hashed one by one.
LONG_WORD = 48
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (the finalizer of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spans(inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross the rows' offsets."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    first = off[:-1][off[:-1] < off[1:]]
    opens[first] = inside[first]
    closes = inside.copy()
    closes[:-1] &= opens[1:] | ~inside[1:]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    size = end - start
    h = size.astype(np.uint64)
    live = np.flatnonzero(size <= LONG_WORD)
    at, last = start[live], end[live]
    k = 0
    while len(live):
        h[live] = (h[live] ^ buf[at + k]) * _STEP
        h[live] ^= h[live] >> np.uint64(29)
        k += 1
        more = at + k < last
        if not more.all():
            live, at, last = live[more], at[more], last[more]
    for i in np.flatnonzero(size > LONG_WORD):
        digest = hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8).digest()
        h[i] = np.frombuffer(digest, np.uint64)[0]
    return mix(h)


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each row where its words start (one more than rows)."""
    lowered = _LOWER[buf]
    start, end = spans(~_SPACE[buf], off)
    return hash_spans(lowered, start, end), np.searchsorted(start, off)


def shingle_sets(buf: np.ndarray, off: np.ndarray, k: int = 5) -> list[np.ndarray]:
    """Each row's sorted distinct 63-bit hashes of ``k`` words in a row; of all its
    words where it has fewer; empty without words."""
    h, first = words(buf, off)
    weights = mix(np.arange(1, k + 1, dtype=np.uint64) * _STEP) | np.uint64(1)
    n = max(len(h) - k + 1, 0)
    rolled = np.zeros(n, np.uint64)
    for j in range(k):
        rolled += h[j : j + n] * weights[j]
    rolled = mix(rolled) >> np.uint64(1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = (h[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix(np.array([short], np.uint64)) >> np.uint64(1))
        else:
            out.append(np.empty(0, np.uint64))
    return out
