"""Suffix order and common prefixes of a block of strings by external induced sorting.

Symbols are bytes plus one; a 0 ends each string. Suffixes that start a rising stretch after a falling one (S*) are sorted
first: the substrings between them get names in order, and the string of names is sorted by recursion on pairs of names, until the
names of a rank cover as many bytes as matter. From them, one pass up the symbols induces the order of the falling (L) suffixes and one
pass down that of the rising (S) suffixes. The queue of each pass is a priority queue by first symbol that hands out equal
symbols in the order of arrival; its tuples are a position and the common prefix with the tuple before it in the same
queue, which is one more than the smallest common prefix met between their sources. Queues beyond a given size go to files.

Common prefixes count up to ``CAP`` bytes. Suffixes equal that far stand in any order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

CAP = 1 << 12
SYMBOLS = 257
PACK = 7


class BucketQueue:
    """First in, first out by symbol; the longest buckets go to disk when more than ``limit`` tuples are held.

    ``store`` opens a named file for writing or reading, as binary streams.
    """

    def __init__(self, limit: int, store: Callable[[str, str], object] | None, name: str):
        self.held: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
        self.files: list[list[str]] = [[] for _ in range(SYMBOLS)]
        self.sizes = np.zeros(SYMBOLS, np.int64)
        self.limit, self.store, self.name, self.spills = limit, store, name, 0

    def push(self, symbols: np.ndarray, positions: np.ndarray, prefixes: np.ndarray) -> None:
        order = np.argsort(symbols, kind="stable")
        symbols = symbols[order]
        tuples = np.stack([positions[order], prefixes[order]])
        cuts = np.flatnonzero(np.diff(symbols)) + 1
        for part, first in zip(np.split(tuples, cuts, axis=1), np.concatenate([[0], cuts]), strict=True):
            c = int(symbols[first])
            self.held[c].append(part)
            self.sizes[c] += part.shape[1]
        while self.store and self.sizes.sum() > self.limit:
            c = int(self.sizes.argmax())
            name = f"{self.name}-{c}-{self.spills}"
            with self.store(name, "w") as f:
                f.write(np.ascontiguousarray(np.concatenate(self.held[c], axis=1).astype("<i8")).tobytes())
            self.files[c].append(name)
            self.held[c], self.sizes[c] = [], 0
            self.spills += 1

    def pop(self, c: int) -> np.ndarray:
        """All tuples of a symbol so far, as (2, n)."""
        parts = []
        for name in self.files[c]:
            with self.store(name, "r") as f:
                parts.append(np.frombuffer(f.read(), "<i8").reshape(2, -1))
        parts += self.held[c]
        self.held[c], self.files[c], self.sizes[c] = [], [], 0
        return np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), np.int64)


def packed(text: np.ndarray, at: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
    """Seven symbols from each position as one number; those after ``ends`` (inclusive) count as larger than all."""
    out = np.zeros(len(at), np.uint64)
    last = len(text) - 1
    for k in range(PACK):
        p = at + k
        symbol = text[np.minimum(p, last)].astype(np.uint64)
        symbol[p > last] = 0
        if ends is not None:
            symbol[p > ends] = 511
        out = (out << np.uint64(9)) | symbol
    return out


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of keys, and how many there are."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])]) if len(keys) else 0
    return rank, int(rank.max()) + 1 if len(rank) else 0


def _names(text: np.ndarray, stars: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ordered names of the substrings from each S* position to the next one."""
    rank, _ = _ranks(packed(text, stars, ends))
    at = PACK
    long = np.flatnonzero(ends - stars >= at)
    while len(long):
        # Substrings equal so far differ, if at all, in their next symbols.
        more = np.full(len(stars), np.iinfo(np.uint64).max, np.uint64)  # an ended one is larger
        more[long] = packed(text, stars[long] + at, ends[long])
        involved = np.isin(rank, np.unique(rank[long]))
        sub = np.flatnonzero(involved)
        words, _ = _ranks(more[sub])
        finer, count = _ranks(rank[sub] * (len(sub) + 1) + words)
        # Room for the finer ranks within the coarse ones.
        spread = rank * (count + 1)
        spread[sub] += finer
        rank, _ = _ranks(spread)
        at += PACK
        long = long[ends[long] - stars[long] >= at]
    return rank


def _star_order(text: np.ndarray, stars: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """S* suffixes in order, and the common prefix of each with the one before it."""
    n = len(stars)
    ends = np.append(stars[1:], len(text) + PACK)  # the text's end is smaller than any symbol
    rank = _names(text, stars, ends)
    # From here on a rank is the place where its group of equals starts; only members of larger groups are ranked anew.
    order = np.argsort(rank, kind="stable")
    same = rank[order]
    starts = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    levels, span = [rank], 1
    open_ = order[np.repeat(np.diff(np.append(starts, n)) > 1, np.diff(np.append(starts, n)))]
    while span * 2 < depth + 2 and len(open_):
        later = np.zeros(len(open_), np.int64)
        inside = open_ + span < n
        later[inside] = rank[open_[inside] + span] + 1
        group = rank[open_]
        key = group * (n + 1) + later
        way = np.argsort(key)
        key, group, members = key[way], group[way], open_[way]
        head = np.concatenate([[True], key[1:] != key[:-1]])
        block = np.concatenate([[True], group[1:] != group[:-1]])
        place = np.arange(len(members))
        first = np.maximum.accumulate(np.where(head, place, 0))
        rank = rank.copy()
        rank[members] = group + first - np.maximum.accumulate(np.where(block, place, 0))
        levels.append(rank)
        span *= 2
        sizes = np.diff(np.append(np.flatnonzero(head), len(members)))
        open_ = members[np.repeat(sizes > 1, sizes)]
        # Names that cover the depth need no more.
        open_ = open_[np.append(stars, len(text))[np.minimum(open_ + span, n)] - stars[open_] < depth]
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    # Names in common, from the longest spans down, then symbols one word at a time.
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        ok = (a + step <= n) & (b + step <= n)
        ok[ok] = levels[k][a[ok]] == levels[k][b[ok]]
        a[ok] += step
        b[ok] += step
    ends_at = np.append(stars, len(text))
    common = ends_at[a] - stars[order[:-1]]
    open_ = np.flatnonzero(common < depth)
    while len(open_):
        p, q = stars[order[:-1][open_]] + common[open_], stars[order[1:][open_]] + common[open_]
        differ = packed(text, p) ^ packed(text, q)
        same = np.full(len(open_), PACK)
        for k in range(PACK):
            same = np.where((differ >> np.uint64(9 * (PACK - 1 - k)) & np.uint64(511) != 0) & (same == PACK), k, same)
        inside = (p + same <= len(text)) & (q + same <= len(text))
        common[open_] += np.where(inside, same, np.minimum(len(text) - p, len(text) - q))
        open_ = open_[(same == PACK) & inside & (common[open_] < depth)]
    prefix = np.zeros(n, np.int64)
    prefix[1:] = np.minimum(common, depth)
    return stars[order], prefix


class _Between:
    """Smallest prefix since each symbol's last push, over waves of sources in order."""

    def __init__(self):
        self.carry = np.zeros(SYMBOLS, np.int64)  # nothing pushed yet: no common symbol

    def pushed(self, prefixes: np.ndarray, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Prefixes of the new tuples, whose sources stand at ``at`` of this wave and have these symbols before them."""
        n = len(prefixes)
        tables, width = [prefixes.astype(np.int32)], 1
        while width * 2 <= n:
            last = tables[-1]
            tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2
        def smallest(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
            out = np.empty(len(lo), np.int64)
            for k in np.unique(level):
                s = level == k
                out[s] = np.minimum(tables[k][lo[s]], tables[k][hi[s] - (1 << k) + 1])
            return out

        order = np.argsort(symbols, kind="stable")
        place, symbol = at[order], symbols[order]
        first = np.concatenate([[True], symbol[1:] != symbol[:-1]])
        low = np.concatenate([[0], place[:-1] + 1])
        low[first] = 0
        found = smallest(low, place)
        found[first] = np.minimum(found[first], self.carry[symbol[first]])
        # What follows each symbol's last push is carried to the next wave.
        self.carry = np.minimum(self.carry, prefixes.min())
        ends = np.flatnonzero(np.append(first[1:], True))
        tail = np.full(len(ends), np.iinfo(np.int64).max)
        rest = place[ends] + 1 < n
        tail[rest] = smallest(place[ends][rest] + 1, np.full(rest.sum(), n - 1))
        self.carry[symbol[ends]] = tail
        out = np.empty(len(symbols), np.int64)
        out[order] = found
        return out

    def passed(self, prefixes: np.ndarray) -> None:
        self.carry = np.minimum(self.carry, prefixes.min())


def _run(text: np.ndarray, p: int, depth: int) -> int:
    """Times that the symbol at ``p`` repeats from there."""
    piece = text[p:p + depth + 1]
    other = np.flatnonzero(piece != piece[0])
    return int(other[0]) if len(other) else len(piece)


def suffix_order(
    text: np.ndarray, depth: int = CAP, limit: int = 1 << 26, store: Callable[[str, str], object] | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the common prefix, up to ``depth``, of each with the one before. ``text`` ends in a 0; no string is empty."""
    n = len(text)
    t = text.astype(np.int64)
    # Rising if the next different symbol is larger; the last suffix counts as rising.
    change = np.flatnonzero(t[1:] != t[:-1])
    rising = np.ones(n, bool)
    if len(change):
        up = t[change + 1] > t[change]
        rising[:change[-1] + 1] = np.repeat(up, np.diff(np.concatenate([[-1], change])))
        rising[change[-1] + 1:n] = False  # a closing run of equal symbols falls to the end of the text
    else:
        rising[:] = False
    rising[n - 1] = True
    stars = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    starred, star_prefix = _star_order(text, stars, depth) if len(stars) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    star_symbol = text[starred].astype(np.int64)
    star_cuts = np.searchsorted(star_symbol, np.arange(SYMBOLS + 1))
    falling_of: list[np.ndarray] = [np.zeros((2, 0), np.int64)] * SYMBOLS
    queue, between = BucketQueue(limit, store, "l"), _Between()

    def induce(wave: np.ndarray, want_rising: bool) -> None:
        positions, prefixes = wave
        at = np.flatnonzero(positions > 0)
        before = positions[at] - 1
        fits = rising[before] == want_rising
        at, before = at[fits], before[fits]
        if len(at):
            symbols = t[before]
            queue.push(symbols, before, np.minimum(between.pushed(prefixes, symbols, at) + 1, depth))
        else:
            between.passed(prefixes)

    for c in range(SYMBOLS):
        done, last = [], -1
        while (wave := queue.pop(c)).shape[1]:
            if not done:
                wave = wave.copy()
                wave[1, 0] = 0 if last < 0 else wave[1, 0]
            done.append(wave)
            induce(wave, False)
            last = int(wave[0, -1])
        if done:
            falling_of[c] = np.concatenate(done, axis=1)
        a, b = star_cuts[c], star_cuts[c + 1]
        if b > a:
            wave = np.stack([starred[a:b], star_prefix[a:b]])
            wave[1, 0] = min(_run(text, last, depth), _run(text, int(wave[0, 0]), depth)) if last >= 0 else 0
            induce(wave, False)

    queue, between = BucketQueue(limit, store, "s"), _Between()
    rising_of: list[np.ndarray] = [np.zeros((2, 0), np.int64)] * SYMBOLS
    for c in range(SYMBOLS - 1, -1, -1):
        done, last = [], -1
        while (wave := queue.pop(c)).shape[1]:
            if not done:
                wave = wave.copy()
                wave[1, 0] = 0
            done.append(wave)
            induce(wave, True)
            last = int(wave[0, -1])
        if done:
            rising_of[c] = np.concatenate(done, axis=1)
        falling = falling_of[c]
        if falling.shape[1]:
            # Downwards, a suffix's prefix is the one that it has with the next larger.
            prefixes = np.append(falling[1, 1:], 0)[::-1].copy()
            if last >= 0:
                prefixes[0] = min(_run(text, last, depth), _run(text, int(falling[0, -1]), depth))
            induce(np.stack([falling[0, ::-1], prefixes]), True)

    positions, prefixes = [], []
    for c in range(SYMBOLS):
        low, high = falling_of[c], rising_of[c]
        if c == 0 and rising[n - 1] and not (high[0] == n - 1).any():
            high = np.concatenate([high, [[n - 1], [int(high.shape[1] > 0)]]], axis=1)  # the last suffix is nobody's successor
        if low.shape[1]:
            positions.append(low[0])
            prefixes.append(low[1])
        if high.shape[1]:
            up = high[:, ::-1]
            p = np.append(0, up[1, :-1])
            if low.shape[1]:
                p[0] = min(_run(text, int(low[0, -1]), depth), _run(text, int(up[0, 0]), depth))
            positions.append(up[0])
            prefixes.append(p)
    return np.concatenate(positions), np.concatenate(prefixes)
