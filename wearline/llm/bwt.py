"""Repeated strings of a fixed length in a bounded block, on its Burrows-Wheeler transform.

``repeated_windows`` expands intervals breadth first: from the empty string
every interval of the transform is extended backwards by each character it
holds, so the intervals of a level are the strings one longer than those of
the level before.  The place where an extended interval ends is a common
prefix of exactly the level's length, if no lower level ended there; the
expansion stops at the asked length, and places still open join suffixes that
share at least that much.

Strings are UTF-8 bytes, which never hold 0xFF; symbol 0 ends each string.
"""

from __future__ import annotations

import numpy as np


U64 = np.uint64


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols or more (prefix doubling).

    Below two million symbols two ranks and the place fit one word, so that a
    round sorts plain numbers.
    """
    n = len(symbols)
    bits = U64(n.bit_length())
    packed = 3 * n.bit_length() <= 64
    padded = np.concatenate([symbols, np.zeros(8, np.uint8)])
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype(np.uint64)
    order = np.argsort(key)
    ordered, step = key[order], 8
    while True:
        new = np.ones(n, np.int32)
        new[0] = 0
        new[1:] = ordered[1:] != ordered[:-1]
        ranks = np.cumsum(new, dtype=np.int32)
        if step >= depth or ranks[-1] == n - 1:
            return order
        rank = np.empty(n, np.int32)
        rank[order] = ranks
        key = rank.astype(np.uint64) << bits
        key[: max(0, n - step)] |= (rank[step:] + 1).astype(np.uint64)
        if packed:
            ordered = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
            order = (ordered & ((U64(1) << bits) - U64(1))).astype(np.int64)
            ordered >>= bits
        else:
            order = np.argsort(key)
            ordered = key[order]
        step *= 2


def repeated_windows(strings: list[bytes], length: int) -> list[np.ndarray]:
    """Per string: a mask of the starts whose next ``length`` bytes also start elsewhere in the block."""
    sizes = np.array([len(s) for s in strings], np.int64)
    raw = np.frombuffer(b"\xff".join(strings) + b"\xff", np.uint8)
    symbols = raw + np.uint8(1)  # 0xFF wraps to 0
    begin = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    marked = _repeated(symbols, length)
    return [marked[b : b + max(0, s - length + 1)] for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)]


def _repeated(symbols: np.ndarray, length: int) -> np.ndarray:
    n = len(symbols)
    order = suffix_order(symbols, length)
    bwt = symbols[order - 1]
    by_symbol = np.argsort(bwt, kind="stable")
    step_back = np.empty(n, np.int32)  # the last-to-first mapping
    step_back[by_symbol] = np.arange(n, dtype=np.int32)
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    same = bwt[by_symbol[1:]] == bwt[by_symbol[:-1]]
    before[by_symbol[1:][same]] = by_symbol[:-1][same]
    after[by_symbol[:-1][same]] = by_symbol[1:][same]
    # inside an interval a symbol occurs first at the interval's or a run's begin, and last at the end of either
    begins = np.zeros(n, bool)
    begins[1:] = bwt[1:] != bwt[:-1]
    heads, upto = np.flatnonzero(begins).astype(np.int32), np.cumsum(begins, dtype=np.int32)
    closed = np.zeros(n + 1, bool)
    closed[[0, n]] = True
    lo, hi = np.array([0], np.int32), np.array([n - 1], np.int32)
    ends = int((symbols == 0).sum())
    for level in range(length):
        if not len(lo):
            break
        runs = upto[hi] - upto[lo]
        uniform, mixed = runs == 0, runs > 0
        a, b, runs = lo[mixed], hi[mixed], runs[mixed]
        inner = heads[np.arange(runs.sum()) + np.repeat(upto[a] - (np.cumsum(runs) - runs), runs)]
        first = np.concatenate([a, inner[before[inner] < np.repeat(a, runs)]])
        last = np.concatenate([b, inner[after[inner - 1] > np.repeat(b, runs)] - 1])
        lo = np.concatenate([step_back[lo[uniform]], np.sort(step_back[first])])
        hi = np.concatenate([step_back[hi[uniform]], np.sort(step_back[last])])
        fresh = ~closed[hi + 1]
        closed[hi[fresh] + 1] = True
        if level:  # a string that goes on after an end is of no use
            fresh &= lo >= ends
        lo, hi = lo[fresh], hi[fresh]
    shared = np.flatnonzero(~closed[:n])
    marked = np.zeros(n, bool)
    marked[order[shared]] = True
    marked[order[shared - 1]] = True
    return marked
