"""Minwise sketches of sets and bags, computed in blocks with numpy."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import xxhash

WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Longest runs of letters and digits of the lower-cased text."""
    return WORD.findall(text.lower())


def bag_hashes(tokens: Sequence[str]) -> np.ndarray:
    """A 32-bit hash for each element of the bag: the n-th copy of a word is an element of its own."""
    seen: dict[str, int] = {}
    out = np.empty(len(tokens), np.uint32)
    for i, t in enumerate(tokens):
        n = seen.get(t, 0)
        seen[t] = n + 1
        out[i] = xxhash.xxh32_intdigest(t, n)
    return out


def set_hashes(items: Sequence[str]) -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(t) for t in set(items)], np.uint32)


class MinHash:
    """``n`` minima of each set under pairwise independent hash functions; empty sets must be left out."""

    def __init__(self, n: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)

    def minima(self, sets: Sequence[np.ndarray], block: int = 4096) -> np.ndarray:
        out = np.empty((len(sets), len(self.a)), np.uint32)
        lo = 0
        while lo < len(sets):
            hi, size = lo, 0
            while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= block):
                size += len(sets[hi])
                hi += 1
            flat = np.concatenate(sets[lo:hi])
            if len(flat) > 16 * block:  # one very long text: in slices
                best = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
                for s in range(0, len(flat), block):
                    best = np.minimum(best, self._hash(flat[s : s + block]).min(1))
                out[lo] = best
            else:
                starts = np.r_[0, np.cumsum([len(x) for x in sets[lo:hi]])[:-1]]
                out[lo:hi] = np.minimum.reduceat(self._hash(flat), starts, axis=1).T
            lo = hi
        return out

    def _hash(self, flat: np.ndarray) -> np.ndarray:
        x = flat[None, :] * self.a[:, None] + self.b[:, None]
        return x ^ (x >> np.uint32(15))


def one_bit(minima: np.ndarray) -> np.ndarray:
    """One bit of each minimum (b-bit minwise hashing, b = 1): bits of two sets differ with (1 - similarity) / 2."""
    return ((minima >> np.uint32(7)) & np.uint32(1)).astype(np.uint8)
