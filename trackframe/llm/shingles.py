"""Word shingles as sets of 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_BYTE = np.random.default_rng(20_240_501).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
SEGMENT = 4_000_000  # bytes of a text that are hashed at once

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """An invertible mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def _power(n: int) -> np.ndarray:
    """Powers of the base up to n, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 256), _BASE, np.uint64)
        grown[0] = 1
        _powers = np.multiply.accumulate(grown)
    return _powers


def _segments(text: bytes):
    at = 0
    while len(text) - at > SEGMENT:
        cut = max(text.rfind(c, at, at + SEGMENT) for c in (b" ", b"\n"))
        if cut <= at:  # one very long word
            found = [p for p in (text.find(c, at + SEGMENT) for c in (b" ", b"\n")) if p >= 0]
            if not found:
                break
            cut = min(found)
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(text: bytes) -> np.ndarray:
    """A hash of every word, words standing between ASCII white space."""
    parts = []
    for segment in _segments(text):
        b = np.frombuffer(segment, np.uint8)
        inside = ~_SPACE[b]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        lengths = ends - starts
        first = np.cumsum(lengths) - lengths
        place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
        parts.append(mixed(np.add.reduceat(_BYTE[b[inside]] * _power(int(lengths.max()))[place], first)
                           + lengths.astype(np.uint64)))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of `words` words, A-Z taken as lower case. A text with fewer
    words has its whole sequence as its one run; without words the set is empty."""
    if not text:
        return np.zeros(0, np.uint64)
    w = word_hashes(text.encode().lower())  # bytes.lower() changes A-Z alone
    if not len(w):
        return w
    k = min(words, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        total = mixed(total * np.uint64(0xD6E8FEB86659FD93) + w[j:len(w) - k + 1 + j])
    return np.unique(total)
