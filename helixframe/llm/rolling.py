"""Hashes of runs of numbers, such as letters of a word or words of a span, for all runs of a block at once.

A run's hash is a polynomial modulo 2 ** 64 of scrambled numbers, by differences of running sums, scrambled again; so equal runs have
equal hashes wherever they stand.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd bases of the polynomials.
BASES = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F
#: Powers that a process keeps at most.
KEPT = 1_100_000


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... modulo 2 ** 64, n or more of them."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known, dtype=np.uint64)
        if n <= KEPT:
            _POWERS[base] = known
    return known


def run_hashes(values: np.ndarray, a: np.ndarray, b: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[a:b] for each of those ranges: of equal runs the same wherever they stand."""
    n = len(values) + 1
    sums = np.zeros(n, np.uint64)
    np.cumsum(values * _powers(base, n)[: n - 1], out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), n)
    return mix((sums[b] - sums[a]) * back[a] ^ (b - a).astype(np.uint64) * _M2)
