"""A minimal perfect hash over distinct 64-bit keys, by cascaded collision-free bit arrays (BBHash, 2017).

Level by level, the remaining keys are hashed into twice as many cells; keys alone in their cell set its bit, the
others go on. A key's slot is the rank of its bit over all levels, so n keys fill slots 0 to n - 1. A lookup visits 1.6
levels on average, whatever n is.
"""

from __future__ import annotations

import numpy as np

_C = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = 0x9E3779B97F4A7C15


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit integers for each seed, so distinct keys never merge."""
    x = keys.astype(np.int64).view(np.uint64) + np.uint64(_STEP * (seed + 1) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _C[0]
    x = (x ^ (x >> np.uint64(27))) * _C[1]
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """sizes: cells of each level (multiples of 64); words: their bits; ranks: bits set before each word."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.starts = np.r_[0, np.cumsum(sizes)]
        self.ranks = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, left = [], [], np.asarray(keys, np.int64)
        while len(left):
            cells = -(-2 * len(left) // 64) * 64
            at = (mixed(left, len(sizes)) % np.uint64(cells)).astype(np.int64)
            alone = np.bincount(at, minlength=cells) == 1
            sizes.append(cells)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(words) if words else np.empty(0, "<u8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that were not in the set, any slot for the others (see fingerprints)."""
        keys = np.asarray(keys, np.int64)
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, cells in enumerate(self.sizes.tolist()):
            if not len(open_):
                break
            at = self.starts[level] + (mixed(keys[open_], level) % np.uint64(cells)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.ranks[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> tuple[bytes, bytes]:
        return self.sizes.astype("<i8").tobytes(), self.words.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, sizes: bytes, words: bytes) -> PerfectHash:
        return cls(np.frombuffer(sizes, "<i8"), np.frombuffer(words, "<u8"))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mixed(np.asarray(keys, np.int64), 1_000_003) >> np.uint64(32)).astype("<u4")
