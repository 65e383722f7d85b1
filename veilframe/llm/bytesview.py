"""Views of Arrow string columns as numpy byte arrays, and vectorised word splitting and hashing on them.

Words are runs of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses those bytes inside a longer character, so
working on bytes gives the same words as working on characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Base of the polynomial hashes; odd, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
_KEPT = 1 << 20  # powers that a worker keeps; what a longer text needs goes again with it
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        t = np.full(n, b, np.uint64)
        t[0] = 1
        out.append(np.cumprod(t, dtype=np.uint64))
    return out[0], out[1]


def powers(n: int, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n (at least); base is odd."""
    if n > _KEPT:
        return _powers(base, n)
    if base not in _tables or len(_tables[base][0]) < n:
        if len(_tables) > 2:
            _tables.clear()
        _tables[base] = _powers(base, min(_KEPT, max(1 << 16, 1 << (n - 1).bit_length())))
    return _tables[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every output bit depends on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def strings(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty. Whole column, no copy of the bytes where there is no null."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    if not len(col) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    o = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]], o - o[0]


def chunks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `most` bytes each; a longer text stands alone. Bounds the working memory, drops nothing."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = ~SEPARATOR[data]
    first = np.empty(len(w) + 1, bool)
    first[0], first[-1] = w[0], False
    np.greater(w[1:], w[:-1], out=first[1:-1])
    last = np.empty(len(w), bool)
    last[-1] = w[-1]
    np.greater(w[:-1], w[1:], out=last[:-1])
    at = offsets[:-1][offsets[1:] > offsets[:-1]]  # starts of texts that are not empty
    first[at] = w[at]
    ends = at[1:] - 1
    last[ends] = w[ends]
    starts = np.flatnonzero(first[:-1])
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, from prefix polynomial hashes."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values[bounds[i]:bounds[i+1]] for each i, 0 for empty ranges."""
    if not len(values):
        return np.zeros(len(bounds) - 1, values.dtype)
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
