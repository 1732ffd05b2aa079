"""The numbers of one seeded Mersenne Twister (MT19937), from any place of its sequence on.

The generator's words are a linear recurrence over bits. The word ``n`` places further on is the sum of those of the next
19,937 words whose places are set in ``x**n`` modulo the recurrence's polynomial, so a generator is moved ahead by any distance
without drawing. Polynomials over bits are whole numbers here, the bit ``k`` standing for ``x**k``.
"""

from __future__ import annotations

import functools
import random

import numpy as np

DEGREE = 19_937
WORDS = 624
PER_DRAW = 2  # words for one number in [0, 1)
BLOCK = 65_536  # draws between the places that tasks begin at


def _words(state: np.ndarray, n: int) -> np.ndarray:
    """``n`` words of the recurrence that begins with the ``state``, the state's own included."""
    out = np.empty(n + 2 * WORDS, np.uint32)
    out[:WORDS] = state
    high, low, magic = np.uint32(0x80000000), np.uint32(0x7FFFFFFF), np.uint32(0x9908B0DF)
    for at in range(WORDS, n, 227):  # as many words as do not need one another
        y = (out[at - WORDS : at - WORDS + 227] & high) | (out[at - WORDS + 1 : at - WORDS + 228] & low)
        out[at : at + 227] = out[at - 227 : at] ^ (y >> np.uint32(1)) ^ np.where(y & np.uint32(1), magic, np.uint32(0))
    return out[:n]


def _spread(x: int) -> int:
    """The square of a polynomial: a zero behind every bit."""
    bits = np.unpackbits(np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8 or 1, "little"), np.uint8), bitorder="little")
    wide = np.zeros(2 * len(bits), np.uint8)
    wide[::2] = bits
    return int.from_bytes(np.packbits(wide, bitorder="little").tobytes(), "little")


def _reduced(x: int, modulus: int) -> int:
    while (over := x.bit_length() - DEGREE - 1) >= 0:
        x ^= modulus << over
    return x


@functools.cache
def polynomial() -> int:
    """The recurrence's polynomial: the shortest that the lowest bits of its words satisfy (Berlekamp and Massey)."""
    bits = (_words(np.arange(1, WORDS + 1, dtype=np.uint32) * np.uint32(2654435761), 2 * DEGREE + 100)[1:] & np.uint32(1)).tolist()
    now, before, length, since, seen = 1, 1, 0, 1, 0
    for n, bit in enumerate(bits):
        seen = (seen << 1) | bit  # the latest bit lowest
        if (now & seen).bit_count() & 1:
            changed = now ^ (before << since)
            if 2 * length <= n:
                now, before, length, since = changed, now, n + 1 - length, 1
                continue
            now = changed
        since += 1
    if length != DEGREE:
        raise ArithmeticError("the recurrence's polynomial was not found")
    # ``now`` is written from the latest word backwards.
    return int(bin(now | (1 << DEGREE + 1))[3:].zfill(DEGREE + 1)[::-1], 2)


@functools.cache
def leaps(block: int = BLOCK) -> tuple[int, ...]:
    """``x`` to the words of 1, 2, 4 ... blocks of draws, enough for any row number."""
    modulus, power, out = polynomial(), 1, []
    for bit in bin(block * PER_DRAW)[2:]:
        power = _reduced(_spread(power) << int(bit), modulus)
    for _ in range(63 - block.bit_length()):
        out.append(power)
        power = _reduced(_spread(power), modulus)
    return tuple(out)


def seeded(seed: int) -> np.ndarray:
    """The state behind Python's ``random.seed(seed)``."""
    return np.array(random.Random(seed).getstate()[1][:WORDS], np.uint32)


def moved(state: np.ndarray, leap: int) -> np.ndarray:
    """The ``state`` as many words ahead as the polynomial ``leap`` says."""
    words = _words(state, DEGREE + WORDS)
    bits = np.unpackbits(np.frombuffer(leap.to_bytes(DEGREE // 8 + 1, "little"), np.uint8), bitorder="little")
    out = np.zeros(WORDS, np.uint32)
    for k in np.flatnonzero(bits).tolist():
        out ^= words[k : k + WORDS]
    return out


def block_draws(state: np.ndarray, block: int, ahead: tuple[int, ...], size: int = BLOCK) -> np.ndarray:
    """The draws ``block * size`` to before ``(block + 1) * size`` from a ``seeded`` state on, given ``leaps(size)``."""
    for k, leap in enumerate(ahead):
        if block >> k & 1:
            state = moved(state, leap)
    source = np.random.RandomState()
    source.set_state(("MT19937", state, WORDS))
    return source.random_sample(size)
