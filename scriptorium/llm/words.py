"""Words, word runs and their 64-bit hashes, in numpy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xC2B2AE3D27D4EB4F)
_C = np.uint64(0xBF58476D1CE4E5B9)
#: A worker's dictionary of word hashes is emptied at this size; it only saves time.
_HELD = 1 << 18
_hashes: dict[str, int] = {}


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case."""
    return WORD.findall(text.lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(31))) * _C
    return x ^ (x >> np.uint64(29))


def word_hashes(found: list[str]) -> np.ndarray:
    held = _hashes
    if len(held) > _HELD:
        held.clear()
    out = []
    for w in found:
        h = held.get(w)
        if h is None:
            h = held[w] = xxhash.xxh64_intdigest(w)
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingles(found: list[str], size: int) -> np.ndarray:
    """The sorted distinct hashes of all runs of `size` words."""
    if len(found) < size:
        return np.empty(0, np.uint64)
    h = word_hashes(found)
    n = len(h) - size + 1
    out = h[:n].copy()
    for k in range(1, size):
        out = mix(out * _A + h[k : k + n] + _B)
    return np.unique(mix(out))


def chains(ring: np.ndarray) -> np.ndarray:
    """The sorted distinct hashes of the chains of a sorted ring: each value with the next, and the one or two places after it."""
    pair = mix(ring * _A + np.roll(ring, -1) * _B)
    return np.unique(np.concatenate([mix(pair * _A + np.roll(ring, -k)) for k in (2, 3)]))
