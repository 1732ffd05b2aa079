"""A minimal perfect hash of 128-bit keys with arrays beside it, as bytes.

Keys are placed level by level: at each level a key has one place in a bit array twice as long as the keys that are
left, and keys that are alone at their place stay there, the others go on. A key's number is the count of bits
before its own, so ``n`` keys have the numbers 0 to ``n - 1``. A key that was never put in may get the number of another;
its stored fingerprint, the key's second half, tells the two apart.
"""

from __future__ import annotations

import io
from dataclasses import dataclass

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPARE = 2  # places for a key at each level
_WORD = 64


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(high ^ _mixed(low + np.uint64(level + 1) * _STEP)) % np.uint64(size)


@dataclass
class PerfectHash:
    """``sizes`` bits at each level, one behind the other in ``words``; ``before``: the bits set before each word."""

    sizes: np.ndarray
    words: np.ndarray
    before: np.ndarray
    prints: np.ndarray

    @classmethod
    def of(cls, high: np.ndarray, low: np.ndarray) -> PerfectHash:
        """From the halves of distinct keys, ``uint64`` each."""
        sizes, arrays = [], []
        left_high, left_low = high, low
        while len(left_high):
            if len(sizes) == 200:
                raise ValueError("the keys are not distinct")
            size = -(-_SPARE * len(left_high) // _WORD) * _WORD
            at = _places(left_high, left_low, len(sizes), size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            arrays.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            stay = ~alone[at]
            left_high, left_low = left_high[stay], left_low[stay]
        words = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
        ends = np.cumsum(np.bitwise_count(words), dtype=np.int64)
        made = cls(np.array(sizes, np.int64), words, ends - np.bitwise_count(words), np.zeros(len(high), np.uint64))
        made.prints[made._numbers(high, low)] = low
        return made

    def _numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number that each key leads to; -1 if it leads to none, which no key that was put in does."""
        found = np.full(len(high), -1, np.int64)
        open_, first = np.arange(len(high)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _places(high[open_], low[open_], level, size)
            word, bit = (at >> np.uint64(6)).astype(np.int64) + first // _WORD, at & np.uint64(63)
            here = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            found[open_[here]] = self.before[word[here]] + np.bitwise_count(below)
            open_, first = open_[~here], first + size
        return found

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Each key's number, -1 for keys that were not put in."""
        found = self._numbers(high, low)
        there = np.flatnonzero(found >= 0)
        found[there[self.prints[found[there]] != low[there]]] = -1
        return found


def to_bytes(index: PerfectHash, **arrays: np.ndarray) -> bytes:
    """``index`` and the ``arrays`` that its numbers lead into."""
    out = io.BytesIO()
    np.savez(out, sizes=index.sizes, words=index.words, before=index.before, prints=index.prints, **arrays)
    return out.getvalue()


def from_bytes(data: bytes) -> tuple[PerfectHash, dict[str, np.ndarray]]:
    with np.load(io.BytesIO(data), allow_pickle=False) as held:
        arrays = {k: held[k] for k in held.files}
    return PerfectHash(*(arrays.pop(k) for k in ("sizes", "words", "before", "prints"))), arrays
