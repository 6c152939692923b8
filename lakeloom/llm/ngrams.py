"""Character n-grams of texts as arrays of 64-bit hashes."""

from __future__ import annotations

from functools import cache

import numpy as np

_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.uint32(32)


@cache
def letters() -> np.ndarray:
    """True at the code points of letters (general categories L*)."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text: letters, and one space for each run of anything else.

    A space is put before and after, so that n-grams know the ends of words.
    """
    points = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    is_letter = letters()[points]
    keep = is_letter.copy()
    keep[0] = True
    keep[1:] |= is_letter[:-1]
    return np.where(is_letter, points, _SPACE)[keep]


def hashes(points: np.ndarray, orders: range) -> list[np.ndarray]:
    """For each order the hashes of the n-grams, in text order (empty where the text is too short)."""
    c = points.astype(np.uint64) + np.uint64(1)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, orders.stop):
        h = h[: max(0, len(c) - n + 1)] * _MUL + c[n - 1 :]
        if n in orders:
            m = (h ^ (h >> np.uint64(29))) * _MIX
            out.append(m ^ (m >> np.uint64(32)))
    return out
