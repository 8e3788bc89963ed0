"""Minimal perfect hashing of distinct 64-bit keys in numpy: levels of bit arrays, ranked."""

from __future__ import annotations

import numpy as np

from gaugemill.llm.windows import mixed

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mixed(keys + _U((level + 1) * _STEP & (1 << 64) - 1)) % _U(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0 to n - 1 of n distinct keys.

    A level has two bits for each key it is given. A key that is alone at its place there sets the bit and gets the number
    of bits set before it; the others go to the next level, about four in ten. A key that was not among them gets some number
    or -1, so callers compare the key that is kept under the number.
    """

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # bits, packed into 64-bit words
        self.ranks, before = [], 0
        for words in levels:
            ones = np.bitwise_count(words).astype(np.int64)
            self.ranks.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())
        self.n = before

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """The hash of distinct keys; equal keys would never part."""
        left, levels = np.asarray(keys, np.uint64), []
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = _places(left, len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        found, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        keys = np.asarray(keys, np.uint64)
        for level, (words, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            if not len(left):
                break
            at = _places(keys[left], level, 64 * len(words))
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & _U(1)).astype(bool)
            below = np.bitwise_count(word[hit] & ((_U(1) << bit[hit]) - _U(1))).astype(np.int64)
            found[left[hit]] = ranks[at[hit] >> 6] + below
            left = left[~hit]
        return found

    def packed(self) -> list[bytes]:
        return [words.tobytes() for words in self.levels]

    @classmethod
    def unpacked(cls, levels: list[bytes]) -> PerfectHash:
        return cls([np.frombuffer(words, "<u8") for words in levels])
