"""Words of Arrow string batches as numpy arrays.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``.
Word hashes are 64 bits, mixed anew after every 8 bytes (words of more than
``LONG`` bytes take a cryptographic hash): deterministic across tasks and runs,
so equal words get equal names on every executor without an exchange.  Work is
cut into slices of whole documents of about ``SLICE_BYTES`` to keep temporary
arrays small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 256 << 10
LONG = 256
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit reaches every output bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        step = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        m = max(n, 2 * SLICE_BYTES)
        p = np.full(m, step, np.uint64)
        p[0] = 1
        _powers[kind] = np.multiply.accumulate(p)
    return _powers[kind]


@dataclass
class Words:
    """Words of a slice of rows ``first .. first + len(bounds) - 1``.

    ``bounds``: word index range of each row; ``starts``/``ends``: byte
    positions in ``data``; ``hashes``: one 64-bit name per word.
    """
    first: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray

    def rows(self) -> Iterator[tuple[int, int, int]]:
        b = self.bounds.tolist()
        return ((self.first + i, b[i], b[i + 1]) for i in range(len(b) - 1))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i]:self.ends[i]].tobytes()

    def joined(self, lo: int, hi: int, keep: np.ndarray | None = None) -> bytes:
        """Words ``lo .. hi - 1`` (those marked in ``keep``) with single spaces."""
        raw = self.data[self.starts[lo]:self.ends[hi - 1]].tobytes() if hi > lo else b""
        words = raw.split()
        return b" ".join(words if keep is None else [w for w, k in zip(words, keep.tolist(), strict=True) if k])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows and their offsets; null rows are empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer row is a range of its own."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One 64-bit name per byte range."""
    left = ends - starts
    h = mix(left.astype(np.uint64) * _U(_BASE) + _U(1))
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    long = np.flatnonzero(left > LONG)
    for k in long.tolist():
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k]:ends[k]].tobytes(), digest_size=8).digest(), "little")
    some, at = np.arange(len(h)), starts
    if len(long):
        some = np.flatnonzero(left <= LONG)
        at, left = starts[some], left[some]
    while len(some):
        part = eight[at].view("<u8")[:, 0]
        part = np.where(left < 8, part & ((_U(1) << (_U(8) * np.minimum(left, 7).astype(np.uint64))) - _U(1)), part)
        h[some] = mix(h[some] ^ part)
        more = left > 8
        some, at, left = some[more], at[more] + 8, left[more] - 8
    return h


def split(column: pa.Array, lower: bool = False, size: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of a string column; ``lower`` folds A-Z in the hashes only."""
    raw, offsets = text_bytes(column)
    for i, j in slices(offsets, size):
        off = offsets[i:j + 1] - offsets[i]
        data = raw[offsets[i]:offsets[j]]
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True                       # rows touch without a separator
        begin, end = solid.copy(), solid.copy()
        if n:
            begin[1:] &= ~solid[:-1] | edge[1:n]
            end[:-1] &= ~solid[1:] | edge[1:n]
        starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        h = word_hashes(_FOLD[data] if lower else data, starts, ends)
        yield Words(i, data, np.searchsorted(starts, off), starts, ends, h)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive entries (rows not separated)."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * _U(_BASE) + h[k:m + k]
    return mix(out)
