"""Polynomial hashes modulo 2**64 of spans of a block, by prefix sums, so that a whole block is hashed in a few numpy passes."""

from __future__ import annotations

from functools import cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_INVERSE = pow(_BASE, -1, 2**64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit hangs on every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _longest(base: int, log2: int) -> np.ndarray:
    return _powers(base, 1 << log2)


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers; up to 2**22 of them are kept for the next block."""
    return _longest(base, max(16, n.bit_length()))[:n] if n < 1 << 22 else _powers(base, n)


_BYTES = mixed(np.arange(1, 257, dtype=np.uint64))


class Spans:
    """Hashes of any spans of a sequence of values.

    values: bytes (uint8) or 64-bit hashes. Equal spans have equal hashes wherever they stand. Different ones nearly always
    differ, but there are spans (such as Thue-Morse sequences) that collide with certainty under any base: what hashes bring together
    has to be compared itself before it counts as equal.
    """

    def __init__(self, values: np.ndarray):
        values = _BYTES[values] if values.dtype == np.uint8 else values
        self.n = len(values)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * powers(_BASE, self.n), out=self.sums[1:])
        self.back = powers(_INVERSE, self.n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The length takes part, so that no value hashes like its absence."""
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))

    def rolling(self, width: int) -> np.ndarray:
        """The hash of every span of `width` values."""
        if self.n < width:
            return np.zeros(0, np.uint64)
        return mixed((self.sums[width:] - self.sums[:-width]) * self.back[: self.n - width + 1] + np.uint64(width))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, by doubling."""
    if len(x) < width:
        return x[:0]
    have, low = 1, x
    while have * 2 <= width:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    rest = width - have
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
