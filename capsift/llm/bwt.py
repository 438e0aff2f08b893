"""Long repeats of a block of texts, from a Burrows-Wheeler transform by interval expansion.

The suffixes of the block are sorted as far as ``min_len`` needs, which gives the
transform.  Intervals of suffixes that share a prefix are then extended by one byte to
the left per level, breadth first.  The right end of every interval that is new at a
level marks a pair of neighbouring suffixes whose common prefix is exactly as long as the
level, so common prefixes come out by increasing value; an interval whose end is known
already is not extended.  The expansion stops at ``min_len``: neighbours that are still
unmarked share at least that much.
"""

from __future__ import annotations

import numpy as np

_END, _BETWEEN = 0, 1  # codes of the end of the block and of the gap between texts


def _by_pair(rank: np.ndarray, after: np.ndarray, suffix: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their pairs of ranks, and the pairs; all are at most ``n``."""
    bits = n.bit_length()
    pair = (rank.astype(np.uint64) << np.uint64(bits)) | after.astype(np.uint64)
    if 3 * bits > 64:
        by = np.argsort(pair)
        return suffix[by], pair[by]
    # values sort many times faster than positions, so the suffix goes along in the low bits
    key = np.sort((pair << np.uint64(bits)) | suffix.astype(np.uint64))
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64), key >> np.uint64(bits)


def sorted_suffixes(codes: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by the next ``depth`` codes at least (ties in any order), by prefix doubling."""
    n = len(codes)
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = (key << np.uint64(8)) | padded[i:i + n]
    order = np.argsort(key)
    ranked = key[order]
    head = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    span = 8
    while span < depth:
        alone = head & np.append(head[1:], True)
        where = np.flatnonzero(~alone)  # whole groups of suffixes that still tie
        if not len(where):
            break
        suffix = order[where]
        further = suffix + span
        after = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        suffix, pair = _by_pair(rank[suffix], after, suffix, n)
        order[where] = suffix
        first = np.concatenate([[True], pair[1:] != pair[:-1]])
        head[where] = first
        rank[suffix] = np.maximum.accumulate(np.where(first, where, 0))
        span *= 2
    return order


def long_neighbours(codes: np.ndarray, order: np.ndarray, min_len: int) -> np.ndarray:
    """Whether suffix ``i`` and suffix ``i - 1`` (in sorted order) share ``min_len`` codes."""
    n = len(codes)
    before = codes[order - 1]  # the transform; the code before position 0 is the end mark
    by_code = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # where a suffix lands when it is extended by its code
    step[by_code] = np.arange(n)
    same = before[by_code][1:] == before[by_code][:-1]
    following, preceding = np.full(n, n), np.full(n, -1)
    following[by_code[:-1][same]] = by_code[1:][same]
    preceding[by_code[1:][same]] = by_code[:-1][same]
    unmarked = np.ones(n + 1, bool)
    unmarked[0] = unmarked[n] = False
    low, high = np.array([0]), np.array([n - 1])
    for _ in range(min_len):
        sizes = high - low + 1
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(low - (ends - sizes), sizes)
        lows = np.sort(step[at[preceding[at] < np.repeat(low, sizes)]])  # the first of each code in each interval
        highs = np.sort(step[at[following[at] > np.repeat(high, sizes)]])  # and the last
        new = unmarked[highs + 1]
        low, high = lows[new], highs[new]
        unmarked[high + 1] = False
        if not len(low):
            break
    return unmarked[:n]


def repeated_starts(texts: list[np.ndarray], min_len: int) -> list[np.ndarray]:
    """Per text (bytes), whether the ``min_len`` bytes from each start also start elsewhere in the block."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    raw = np.zeros(int(sizes.sum()) + len(texts) + 1, np.uint8)
    present = np.zeros(256, bool)
    for text in texts:
        present[text] = True
    # UTF-8 never uses 13 of the byte values, so two codes are free
    table = (np.cumsum(present) + 1).astype(np.uint8)
    raw[:] = _BETWEEN
    for start, text in zip(starts.tolist(), texts):
        raw[start:start + len(text)] = table[text]
    raw[-1] = _END
    order = sorted_suffixes(raw, min_len)
    long = long_neighbours(raw, order, min_len)
    repeated = np.zeros(len(raw), bool)
    repeated[order[long]] = True
    repeated[order[np.flatnonzero(long) - 1]] = True
    return [repeated[start:start + max(0, size - min_len + 1)] for start, size in zip(starts.tolist(), sizes.tolist())]
