"""A rolling hash of byte ranges: any range's hash from two prefix sums, for whole arrays of ranges at once.

The hash of b[i:j] is the sum of (b[k] + 1) * BASE ** (k - i) modulo 2 ** 64, mixed. It depends on the bytes alone, not on
where they stand. It chooses cuts and sorts out what can't matter; whoever relies on equal bytes compares the bytes.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, out=out)


class Rolling:
    """Hashes of ranges of `data`; `room` keeps the powers from step to step."""

    def __init__(self, data: np.ndarray, room: dict[str, np.ndarray]):
        n = len(data) + 1
        if len(room.get("up", ())) < n:
            room["up"], room["down"] = powers(BASE, n), powers(INVERSE, n)
        self.down = room["down"][:n]
        self.sums = np.zeros(n, np.uint64)
        terms = data.astype(np.uint64)
        terms += np.uint64(1)
        terms *= room["up"][: n - 1]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends]
        h -= self.sums[starts]
        h *= self.down[starts]
        return mixed(h)

    def windows(self, width: int) -> np.ndarray:
        """The hash of the window that ends before each place from `width` on."""
        h = self.sums[width:] - self.sums[:-width]
        h *= self.down[: len(h)]
        return mixed(h)
