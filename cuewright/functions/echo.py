"""Removal of echoes: the same unit of text several times in a row.

A unit of three characters or more that comes twice or more stays once, a unit of one or two that comes
three times or more stays twice; units have ``LONGEST`` characters at most, and at each place the smallest
unit counts. As a regular expression this tries every length at every place of a text. Here all texts of a
batch are compared with themselves, shifted by each length in turn, in array operations; what is left to
do place by place are the few places at which a unit does repeat.
"""

from __future__ import annotations

import numpy as np

LONGEST = 128
BLOCK = 1 << 16  # characters that are worked on at once


def _in_a_row(places: np.ndarray, n: int) -> np.ndarray:
    """Those of rising ``places`` that begin ``n`` places in a row."""
    first = places[: max(0, len(places) - n + 1)]
    return first[places[n - 1 :] - first == n - 1]


def _shifts(points: np.ndarray, longest: int) -> np.ndarray:
    """For each place the smallest unit that repeats from there on, 0 for none.

    Characters are compared three at a time, packed into one number, so that few places are equal by chance."""
    best = np.zeros(len(points), dtype=np.uint8)
    wide = points.astype(np.uint64)
    threes = (wide[:-2] << np.uint64(42)) | (wide[1:-1] << np.uint64(21)) | wide[2:]
    for length in range(1, min(longest, len(points) // 2) + 1):
        if length == 1:
            found = _in_a_row(np.flatnonzero(points[1:] == points[:-1]), 2)
        else:
            found = _in_a_row(np.flatnonzero(threes[length:] == threes[:-length]), (4 if length == 2 else length) - 2)
        best[found[best[found] == 0]] = length
    return best


def collapse_all(texts: list[str]) -> list[str]:
    """Every text without its echoes."""
    out, at = [], 0
    while at < len(texts):
        upto, held = at, 0
        while upto < len(texts) and (upto == at or held < BLOCK):
            held += len(texts[upto])
            upto += 1
        out += _collapsed(texts[at:upto])
        at = upto
    return out


def _collapsed(texts: list[str]) -> list[str]:
    # A mark that differs each time ends a text, so that no unit repeats across it.
    ends = np.cumsum([len(t) + 1 for t in texts])
    points = np.zeros(int(ends[-1]), dtype=np.uint32)
    whole = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    points[:] = whole
    points[ends - 1] = np.arange(len(texts), dtype=np.uint32) + 0x110000  # 21 bits hold these too
    best = _shifts(points, LONGEST)
    places = np.flatnonzero(best)
    first = np.searchsorted(places, ends - 1 - [len(t) for t in texts])
    last = np.searchsorted(places, ends - 1)
    out = []
    for text, end, i, j in zip(texts, ends.tolist(), first.tolist(), last.tolist(), strict=True):
        if i == j:
            out.append(text)
            continue
        start, done, parts = end - 1 - len(text), 0, []
        for place in places[i:j].tolist():
            at = place - start
            if at < done:
                continue
            unit = text[at : at + int(best[place])]
            parts.append(text[done:at] + (unit if len(unit) > 2 else unit * 2))
            done = at + len(unit)
            while text.startswith(unit, done):
                done += len(unit)
        out.append("".join(parts) + text[done:])
    return out
