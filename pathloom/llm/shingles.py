"""Hashes of words and of runs of words, for the operators on word sequences."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words a task remembers the hash of; when there are more it starts afresh.
MEMO_WORDS = 250_000
U = np.uint64
#: Odd multipliers for runs of words; one for each independent hash.
FIRST, SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


class WordHashes(dict):
    """Word -> 64-bit hash; misses are computed."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of each 64-bit value over all its bits."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def runs(h: np.ndarray, k: int, multiplier: int = FIRST) -> np.ndarray:
    """A hash of each run of k words, from the words' hashes; none if there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U)
    out, power = h[:n].copy(), 1
    for j in range(1, k):
        power = power * multiplier & _MASK
        out += h[j : j + n] * U(power)
    return mix(out + U(k))


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct hashes of the runs of k words; of fewer words, one of the whole sequence; of none, none."""
    return np.unique(runs(h, min(k, len(h)))) if len(h) else np.empty(0, U)
