"""Vectorised hashing of byte buffers: word and n-gram hashes, sliding minima.

All functions take whole Arrow string buffers (many documents one after another)
and use wrapping 64-bit arithmetic; ``bounds[i]:bounds[i + 1]`` is document i.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys

import numpy as np
import pyarrow as pa

BASE = 0x9E3779B97F4A7C15
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i up to n, modulo 2**64."""
    if len(_POWERS["up"]) <= n:
        size = max(n + 1, 2 * len(_POWERS["up"]))
        for name, step in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, step, np.uint64)
            table[0] = 1
            _POWERS[name] = np.cumprod(table, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary array and the bounds of its items; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or bounds[-1] == bounds[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, limit: int):
    """Ranges of documents with up to ``limit`` symbols each (one document at least)."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, last
        first = last


def prefix(symbols: np.ndarray) -> np.ndarray:
    """Prefix sums from which ``span_hash`` gets the hash of any range."""
    up, _ = powers(len(symbols))
    out = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum((symbols + np.uint64(1)) * up[: len(symbols)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, down = powers(len(pre))
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64))


def gram_hash(pre: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ranges of k symbols."""
    n = len(pre) - 1 - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    _, down = powers(len(pre))
    return mix((pre[k:] - pre[:-k]) * down[:n] + np.uint64(k))


def sliding(values: np.ndarray, width: int, best=np.minimum) -> np.ndarray:
    """best of each ``width`` neighbours, by doubling."""
    if len(values) < width:
        return values[:0]
    span = 1
    while span * 2 <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    return best(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def trim() -> None:
    """Give freed memory back to the system. Python workers stay for later stages and would keep it."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches ``inside`` that no bound cuts, and for each document the bounds of its stretches."""
    if not len(inside):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(bounds), np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[bounds] = True
    starts = np.flatnonzero(inside & (cut[:-1] | ~np.concatenate(([False], inside[:-1]))))
    ends = np.flatnonzero(inside & (cut[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and for each document the bounds of its words."""
    return runs(~is_space(data), bounds)


#: Words of more bytes are hashed by BLAKE2b.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of scrambled (place, byte) pairs. A polynomial would give some long words equal hashes for certain (those of Thue and Morse)."""
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    short = np.flatnonzero(size <= LONG_WORD)
    if len(short):
        n = size[short]
        begin = np.cumsum(n) - n
        place = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(begin, n)
        symbol = data[place + np.repeat(starts[short], n)].astype(np.uint64) + (place.astype(np.uint64) << np.uint64(8)) + np.uint64(1)
        out[short] = mix(np.add.reduceat(mix(symbol * np.uint64(BASE)), begin) + n.astype(np.uint64)) if len(symbol) else 0
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out
