"""Anchors: the minimizers that cut texts at places fixed by their content.

Any ``length``-byte string has one anchor, the ``ANCHOR``-byte substring with the
smallest hash in it (ties: the leftmost).  Equal strings have equal anchors at equal
offsets, wherever they stand, so strings only need comparing with strings of the
same anchor.
"""

from __future__ import annotations

import numpy as np

#: Bytes of an anchor.
ANCHOR = 32
_MULTIPLIER = 0x9E3779B97F4A7C15
#: Starts handled at a time; positions inside such a part fit the low bits of a key.
PART = 1 << 20
_LOW = np.uint64((1 << 22) - 1)


def gram_hashes(text: np.ndarray, size: int = ANCHOR) -> np.ndarray:
    """64-bit hashes of all ``size``-byte substrings (``size`` a power of two)."""
    h = text.astype(np.uint64) + np.uint64(1)
    factor, span = _MULTIPLIER, 1
    while span < size:
        h = h[:-span] * np.uint64(factor) + h[span:]
        factor = factor * factor % (1 << 64)
        span *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _window_min(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive keys, by running minima from both ends
    of fixed blocks."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def find(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position, first, last): each anchor of ``text`` and the range of starts
    of the ``length``-byte strings whose anchor it is."""
    n = len(text) - length + 1
    out: list[tuple[np.ndarray, ...]] = []
    raw = np.frombuffer(text, np.uint8)
    width = length - ANCHOR + 1
    for at in range(0, n, PART):
        starts = min(PART, n - at)
        h = gram_hashes(raw[at:at + starts + length - 1])
        keys = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
        where = (_window_min(keys, width) & _LOW).astype(np.int64)
        cut = np.flatnonzero(np.diff(where)) + 1
        first = np.concatenate([[0], cut])
        last = np.concatenate([cut, [starts]]) - 1
        position = where[first]
        out.append((h[position], position + at, first + at, last + at))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(c) for c in zip(*out))
