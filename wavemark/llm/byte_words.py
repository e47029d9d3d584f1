"""Hashes of the words of many texts at once, by numpy over one array of bytes."""

from __future__ import annotations

import numpy as np

#: An odd value of 64 bits a byte, and an odd factor a place.
_VALUES = np.random.default_rng(20_011).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = 0x9E3779B97F4A7C15
_powers = _inverse = np.ones(1, np.uint64)


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the factor, and of its inverse modulo 2^64, up to n."""
    global _powers, _inverse
    if len(_powers) <= n:
        n = max(n + 1, 1 << 20)
        one = np.ones(n, np.uint64)
        one[1:] = _FACTOR
        _powers = np.multiply.accumulate(one)
        one[1:] = pow(_FACTOR, -1, 1 << 64)
        _inverse = np.multiply.accumulate(one)
    return _powers, _inverse


def hashes(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits for each span of the bytes: the same for the same bytes, wherever they stand."""
    powers, inverse = _grown(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[raw] * powers[: len(raw)], out=total[1:])
    return (total[at + size] - total[at]) * inverse[at]
