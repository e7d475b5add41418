"""Minimal perfect hashing of 128-bit keys, built and probed with numpy.

Levels of bit arrays: a key settles at the first level where no other key
shares its slot, and its index is the number of settled keys before it.  About
three bits a key, plus a 64-bit fingerprint and a 32-bit count.
"""

from __future__ import annotations

import pickle

import numpy as np

from grainmill.llm.text import mix

SLOTS_PER_KEY = 1.6
_WORD_BITS = 64


def _slots(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = mix(high + np.uint64(level) * np.uint64(0xA0761D6478BD642F)) ^ mix(low ^ mix(np.full(1, level + 1, np.uint64)))
        return (mix(mixed) % np.uint64(size)).astype(np.int64)


class CountTable:
    """Counts of a fixed set of 128-bit keys, indexed by a minimal perfect hash."""

    def __init__(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray):
        """The keys (high, low) must be distinct."""
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        settled, left = 0, np.arange(len(high))
        order = np.empty(len(high), np.int64)
        while len(left):
            size = -(-int(SLOTS_PER_KEY * len(left) + 1) // _WORD_BITS) * _WORD_BITS
            at = _slots(high[left], low[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            before = np.concatenate([[0], np.cumsum(alone.reshape(-1, _WORD_BITS).sum(axis=1))])[:-1] + settled
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            self.levels.append((words, before.astype(np.uint32), size))
            hit = alone[at]
            order[left[hit]] = settled + np.cumsum(alone)[at[hit]] - 1
            settled += int(hit.sum())
            left = left[~hit]
        self.fingerprints = np.empty(len(high), np.uint64)
        self.counts = np.empty(len(high), np.uint32)
        self.fingerprints[order] = high
        self.counts[order] = np.minimum(counts, 0xFFFFFFFF)

    def index(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The index of each key, any index or -1 for a key outside the set."""
        out, left = np.full(len(high), -1, np.int64), np.arange(len(high))
        for level, (words, before, size) in enumerate(self.levels):
            at = _slots(high[left], low[left], level, size)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            lower = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = before[at[hit] >> 6] + np.bitwise_count(lower)
            left = left[~hit]
        return out

    def get(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The counts; 0 where the fingerprint shows that the key is not in the set."""
        at = self.index(high, low)
        known = at >= 0
        known[known] = self.fingerprints[at[known]] == high[known]
        counts = np.zeros(len(high), np.uint32)
        counts[known] = self.counts[at[known]]
        return counts

    def pack(self) -> bytes:
        return pickle.dumps(self, protocol=5)

    @staticmethod
    def unpack(data: bytes) -> "CountTable":
        return pickle.loads(data)
