r"""Sets of word shingles as sorted arrays of 64-bit hashes.

Letters A-Z are lower-cased; words are runs of characters other than ``\x20\x09-\x0D``. A set holds the
hashes of the distinct runs of ``width`` words; a text with fewer words has one shingle, its whole
sequence; a text without words has none.
"""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


class WordHashes(dict):
    """Hashes of words; forgets all when it has grown past ``room``."""

    room = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.room:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


_words = WordHashes()


def forget() -> None:
    _words.clear()


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    mixed = h[:n] * _ODD[0]
    for k in range(1, width):
        mixed = (mixed ^ (mixed >> np.uint64(31))) * _ODD[k % 5] + h[k : n + k]
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _ODD[0]
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where elements of ``b`` are in the sorted ``a``."""
    if not len(a) or not len(b):
        return np.zeros(len(b), bool)
    return a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b


def prefix_length(n: int, percent: int) -> int:
    """How many elements of a set of size n, least first, hold one of any set that links with it."""
    return n + (-percent * n // 100) + 1


def common(one: np.ndarray, many: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of one set with each of many."""
    if not many:
        return np.zeros(0, np.int64)
    ends = np.cumsum([len(x) for x in many])
    total = np.concatenate([[0], np.cumsum(shared(one, np.concatenate(many)))])
    return np.diff(total[np.concatenate([[0], ends])])
