"""Words and hashes of a batch of texts, as numpy arrays over its UTF-8 bytes.

A batch is the concatenated bytes of some documents with their offsets, taken
from Arrow buffers without creating Python strings.  Nothing crosses a
document border.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_POWERS: dict[str, np.ndarray] = {}


def _byte_values(lower: bool) -> np.ndarray:
    values = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
    if lower:
        values = values.copy()
        values[65:91] = values[97:123]
    return values


_VALUES = {flag: _byte_values(flag) for flag in (False, True)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
#: Digits, ASCII letters and every byte of a character beyond ASCII.
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        n = max(n, 1 << 20)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            p = np.full(n, U64(base), dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.cumprod(p, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(33))) * _MIX1
    h = (h ^ (h >> U64(33))) * _MIX2
    return h ^ (h >> U64(33))


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n, at = len(column), column.offset
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[at : at + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer document is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


class Words:
    """Words of the documents of a batch.

    ``start``/``end``: byte range of each word; ``doc``: its document;
    ``first``: index of each document's first word (one more than documents).
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        self.data, self.offsets = data, offsets
        mask = is_word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(data), bool)
        after = np.empty(len(data), bool)
        if len(data):
            before[0], before[1:] = False, mask[:-1]
            after[-1], after[:-1] = False, mask[1:]
        self.start = np.flatnonzero(mask & (~before | edge[:-1]))
        self.end = np.flatnonzero(mask & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word's bytes, ASCII case folded if ``lower``."""
        up, down = _powers(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_VALUES[lower][self.data] * up[: len(self.data)], dtype=np.uint64, out=sums[1:])
        h = (sums[self.end] - sums[self.start]) * down[self.start]
        return mix(h ^ ((self.end - self.start).astype(np.uint64) * _MIX2))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` values, by its first index (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * U64(_BASE) + h[j : j + n]
    return mix(out)
