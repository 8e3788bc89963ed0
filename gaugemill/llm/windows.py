"""Rabin-Karp hashes of fixed-length windows in numpy, and runs of windows that share a minimizer.

Equal windows hold the same parts, hence the same smallest part at the same offset. So windows are gathered in *runs*:
consecutive windows of one text whose smallest part lies at the same place. Equal windows lie in runs of equal *part*
hash, never in the same run. A run stands for dozens of windows, which is what makes counting every window affordable;
no window is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gaugemill.llm.common import BLANKS, text_bytes

_U = np.uint64
#: Odd base of the polynomial hash, and its inverse modulo 2 to the 64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: A 64-bit value for each byte, drawn once by a fixed seed.
BYTE_VALUES = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_IS_BLANK = np.isin(np.arange(256), np.frombuffer(BLANKS.encode(), np.uint8))
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: Bits of an entry that name a place; the rest compare parts. Longer inputs are worked on in overlapping chunks.
_PLACE_BITS = 24
CHUNK = 1 << (_PLACE_BITS - 1)

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse."""
    if len(_powers["up"]) <= n:
        size = max(n + 1, 2 * len(_powers["up"]))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Prefixes:
    """Sums of a sequence from which the hash of any stretch follows."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values))
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], dtype=np.uint64, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of the stretches from ``starts`` to before ``ends``; lengths take part."""
        found = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mixed(found + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))

    def every(self, length: int) -> np.ndarray:
        """Hashes of all stretches of ``length``, by where they start."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        found = (self.sums[length:] - self.sums[:n]) * self.down[:n]
        return mixed(found + _U(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def words_of(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A hash value for each word of all texts, A-Z ``lower``-cased or not, and the index at which each text's words
    begin (one entry more)."""
    data, texts = text_bytes(column)
    data = _LOWER[data] if lower else data
    solid = ~_IS_BLANK[data]
    first = np.zeros(len(data) + 1, bool)
    first[texts] = True
    starts = np.flatnonzero(solid & (first[:-1] | ~np.concatenate([[False], solid[:-1]])))
    ends = np.flatnonzero(solid & (first[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    return Prefixes(BYTE_VALUES[data]).of(starts, ends), np.searchsorted(starts, texts)


def smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, from minima of blocks in both directions."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def runs(values: np.ndarray, texts: np.ndarray, window: int, part: int) -> dict[str, np.ndarray]:
    """All runs of windows in all texts: ``text`` (its index), ``first`` window and number ``n`` of windows, the hash
    ``part`` of the smallest part, and the hash ``whole`` of all that the windows cover."""
    out: list[dict[str, np.ndarray]] = []
    of = np.repeat(np.arange(len(texts) - 1), np.diff(texts))
    for base in range(0, max(1, len(values) - window + 1), CHUNK):
        chunk = values[base:base + CHUNK + window - 1]
        if len(chunk) < window:
            break
        sums = Prefixes(chunk)
        parts = sums.every(part)
        places = np.arange(len(parts), dtype=np.uint64)
        entry = (parts >> _U(_PLACE_BITS) << _U(_PLACE_BITS)) | places
        least = (smallest(entry, window - part + 1) & _U((1 << _PLACE_BITS) - 1)).astype(np.int64)
        text = of[base:base + len(least)]
        inside = np.arange(base, base + len(least)) + window <= texts[text + 1]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | (least[1:] != least[:-1])
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | (least[1:] != least[:-1])
        starts, lasts = np.flatnonzero(opens), np.flatnonzero(closes)
        out.append({
            "text": text[starts], "first": starts + base - texts[text[starts]], "n": lasts - starts + 1,
            "part": parts[least[starts]], "whole": sums.of(starts, lasts + window),
        })
    names = ("text", "first", "n", "part", "whole")
    return {k: np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k in names}


def shingles(values: np.ndarray, texts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` consecutive words, and the text each is in; a text of fewer words has one, of all of them."""
    counts = np.diff(texts)
    sums = Prefixes(values)
    whole = np.maximum(counts - size + 1, 0)
    of = np.repeat(np.arange(len(counts)), whole)
    start = texts[of] + np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
    short = np.flatnonzero((counts > 0) & (counts < size))
    return (np.concatenate([sums.of(start, start + size), sums.of(texts[short], texts[short + 1])]),
            np.concatenate([of, short]))


def spans(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true entries."""
    edges = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def covered(size: int, packed: np.ndarray) -> np.ndarray:
    """Which of ``size`` places the stretches cover that ``packed`` holds as start * 2**32 + length."""
    steps = np.zeros(size + 1, np.int64)
    starts = packed >> 32
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + (packed & 0xFFFFFFFF), -1)
    return np.cumsum(steps[:-1]) > 0
