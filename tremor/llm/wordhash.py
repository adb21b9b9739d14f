"""Words and word windows of many texts at once, as 64-bit hashes in numpy.

A chunk of texts is one byte array. A polynomial prefix hash gives every word's hash from two look-ups,
so no Python object is made for a word. Word borders: the bytes 0x20 and 0x09 to 0x0D, and the ends of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WEIGHTS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3,
                     0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0xC2B2AE3D27D4EB4F], np.uint64)
_BYTES = np.cumprod(np.full(256, 0xD1342543DE82EF95, np.uint64), dtype=np.uint64)  # a fixed odd number for each byte
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            full = np.full(n, b, np.uint64)
            full[0] = 1
            _powers[k] = np.cumprod(full, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = hash of data[i:j] times base**i."""
    h = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(len(data) + 1)[0][: len(data)], out=h[1:])
    return h


def chunks(col: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets of the rows in bytes) for runs of rows of about ``limit`` bytes. Nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


class Words:
    """Words of one chunk. ``start``/``end``: byte borders; ``first``: index of each text's first word, one more at the end."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = True):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.ones(n, bool)
        before[1:] = ~solid[:-1]
        after = np.ones(n, bool)
        after[:-1] = ~solid[1:]
        self.start = np.flatnonzero(solid & (before | edge[:-1]))
        self.end = np.flatnonzero(solid & (after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off)
        h = prefix_hash(self.data)
        self.hash = mix((h[self.end] - h[self.start]) * powers(n + 1)[1][self.start])

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of k words from each word on, and whether the k words lie in one text."""
        w, n = self.hash, len(self.hash)
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out[: n - j] += w[j:] * _WEIGHTS[j % len(_WEIGHTS)] * np.uint64(2 * (j // len(_WEIGHTS)) + 1)
        last = np.repeat(self.first[1:], np.diff(self.first))
        return mix(out), np.arange(n) + k <= last

    def sets(self, k: int) -> Iterator[np.ndarray]:
        """For each text the sorted distinct hashes of its k-word shingles; of the whole text if it has fewer words; empty if none."""
        out, ok = self.windows(k)
        for a, b in zip(self.first[:-1].tolist(), self.first[1:].tolist()):
            if b - a >= k:
                yield np.unique(out[a : b - k + 1])
            elif b > a:
                yield self.short(a, b)
            else:
                yield np.zeros(0, np.uint64)

    def short(self, a: int, b: int) -> np.ndarray:
        return mix((self.hash[a:b] * _WEIGHTS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
