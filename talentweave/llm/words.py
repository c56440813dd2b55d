"""Hashes of words and word shingles of many texts at once."""

from __future__ import annotations

import numpy as np

POWERS = np.cumprod(np.full(64, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
#: Bytes that end a word: ASCII white space.
IN_WORD = np.ones(256, bool)
IN_WORD[[9, 10, 11, 12, 13, 32]] = False
SHINGLE = 5
FACTORS = np.array([0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[bytes], inside: np.ndarray = IN_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(hash, text number, start, end)`` of every word; offsets count bytes from the start of its text."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    member = np.concatenate([[False], inside[raw], [False]])
    edges = np.flatnonzero(member[1:] != member[:-1])
    starts, ends = edges[::2], edges[1::2]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    if not len(starts):
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    # A byte's value depends on its place, also beyond the table of powers.
    values = mixed(raw[member[1:-1]].astype(np.uint64) + (place.astype(np.uint64) >> np.uint64(6) << np.uint64(8))) * POWERS[place & 63]
    doc = np.searchsorted(bounds, starts, "right")
    begin = np.concatenate([[0], bounds[:-1]])[doc]
    return mixed(np.add.reduceat(values, first)), doc, starts - begin, ends - begin


def shingle_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(hash, text number)`` of every run of five words; a shorter text with words is one shingle."""
    word, doc, _, _ = word_hashes(texts)
    n = len(word) - SHINGLE + 1
    found, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if n > 0:
        whole = doc[SHINGLE - 1:] == doc[:n]
        total = np.zeros(n, np.uint64)
        for i, f in enumerate(FACTORS):
            total += word[i:n + i] * f
        found, owner = mixed(total[whole]), doc[:n][whole]
    counts = np.bincount(doc, minlength=len(texts)) if len(doc) else np.zeros(len(texts), int)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        at = np.searchsorted(doc, short)
        extra = [mixed(np.array([sum(int(w) * int(f) for w, f in zip(word[a:a + counts[s]], FACTORS, strict=False)) + int(counts[s]) & (1 << 64) - 1], np.uint64))[0] for a, s in zip(at, short, strict=True)]
        found, owner = np.append(found, np.array(extra, np.uint64)), np.append(owner, short)
        order = np.argsort(owner, kind="stable")
        found, owner = found[order], owner[order]
    return found, owner
