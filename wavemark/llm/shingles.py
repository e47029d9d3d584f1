"""Distinct word shingles of whole texts as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MASK = (1 << 64) - 1
_STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Lower-cases A-Z, splits at blank, tab, newline, vertical tab, form feed and return, and hashes word windows."""

    def __init__(self, words: int = 5, cached: int = 250_000):
        self.words, self.cached, self.known = words, cached, _Words()
        self.powers = [np.uint64(pow(int(_STEP), k, 1 << 64)) for k in range(words)]

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The sorted distinct hashes; fewer words than a window are one shingle, no words none."""
        found = text.lower().split() if text else []  # bytes: only A-Z, and only the six blanks
        if not found:
            return np.empty(0, np.uint64)
        if len(self.known) > self.cached:
            self.known = _Words()
        hashes = np.fromiter(map(self.known.__getitem__, found), np.uint64, len(found))
        if len(found) < self.words:
            return mixed((hashes * np.array(self.powers[: len(found)], np.uint64)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(found)))
        n = len(found) - self.words + 1
        sums = np.zeros(n, np.uint64)
        for k, power in enumerate(self.powers):
            sums += hashes[k : k + n] * power
        found = np.sort(mixed(sums))
        return found[np.concatenate(([True], found[1:] != found[:-1]))]
