"""Words of UTF-8 texts as numpy arrays: bounds, hashes and windows, without a Python object for each word.

A word is a longest run of bytes other than space, tab, line feed, vertical tab, form feed and
carriage return; in UTF-8 these bytes are never part of another character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict[str, np.ndarray] = {}


def bounds(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and for each text the index of its first word (one entry more than texts). ``gap``: which bytes part words."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[(offsets > 0) & (offsets < n)]
    begins[edges] = inside[edges]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64, at least n + 1 of them."""
    key = f"p{base}"
    have = _tables.get(key)
    if have is None or len(have) < n + 1:
        size = max(n + 1, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _tables[key] = have
    return have


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _powers(base, len(values))[: len(values)], out=out[1:])
    return out


#: Odd multipliers and their inverses modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
INVERSES = tuple(pow(b, -1, 1 << 64) for b in BASES)


def _byte_values(seed: int) -> np.ndarray:
    key = f"v{seed}"
    if key not in _tables:
        _tables[key] = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
    return _tables[key]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    k = seed % 2
    prefix = _prefix(_byte_values(seed)[data], BASES[k])
    out = (prefix[ends] - prefix[starts]) * _powers(INVERSES[k], len(data))[starts]
    return mix(out + (ends - starts).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def window_hashes(word_hash: np.ndarray, width: int, at: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``width`` words from each word index of ``at``; the caller keeps windows inside a text."""
    if not len(at):
        return np.zeros(0, np.uint64)
    k = seed % 2
    prefix = _prefix(word_hash, BASES[k])
    return mix((prefix[at + width] - prefix[at]) * _powers(INVERSES[k], len(word_hash))[at] + np.uint64(seed))


def as_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words themselves, as one Arrow binary array."""
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=offsets[1:])
    kept = data[~SPACE[data]]
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])


def ranges(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """begin[0], begin[0]+1, ... of each range, one after the other."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.repeat(begin - before, length) + np.arange(total)
