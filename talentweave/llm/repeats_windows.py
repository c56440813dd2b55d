"""Groups of byte windows that could be equal: every window of a fixed size goes to its smallest k-gram.

Equal windows hold the same k-grams, so they choose the same one at the same offset. Consecutive windows of a text that
choose the same occurrence form a stretch; a window can only be repeated if the k-gram of its stretch is.
"""

from __future__ import annotations

import numpy as np

GRAM = 32
#: Positions within a segment take the low bits of a k-gram's rank.
PLACE_BITS = 22
SEGMENT = 1 << 21

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position, by doubling."""
    h = raw.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)
    h *= MULTIPLIER
    h ^= h >> np.uint64(32)
    size = 1
    while size < GRAM:
        h = h[:-size] * np.uint64(0xD6E8FEB86659FD93) + h[size:]
        h *= MULTIPLIER
        h ^= h >> np.uint64(29)
        size *= 2
    return h


def window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Smallest of each ``size`` values in a row, from running minima over blocks of that size."""
    n = len(values) - size + 1
    blocks = -(-len(values) // size)
    padded = np.full(blocks * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    grid = padded.reshape(blocks, size)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[size - 1:size - 1 + n])


def stretches(raw: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(k-gram hash, first start, last start)`` of each stretch of windows of a text."""
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(raw) < window:
        return empty
    found = []
    starts = len(raw) - window + 1
    for at in range(0, starts, SEGMENT):
        part = raw[at:at + SEGMENT + window - 1]
        hashes = gram_hashes(part)
        rank = (hashes >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | np.arange(len(hashes), dtype=np.uint64)
        chosen = window_minima(rank, window - GRAM + 1)
        first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        last = np.append(first[1:], len(chosen)) - 1
        found.append((hashes[(chosen[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)], first + at, last + at))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
