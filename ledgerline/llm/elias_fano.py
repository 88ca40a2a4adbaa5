"""Elias-Fano lists: n non-decreasing numbers up to u in about n * (2 + log2(u / n)) bits, with a select structure."""

from __future__ import annotations

import struct

import numpy as np

#: Every how many ones of the upper bits the place of one is stored.
SAMPLE = 256


class EliasFano:
    """Bytes: n, u as unsigned 64-bit, low width and sample count as 32-bit, low bits, upper bits, samples (32-bit)."""

    def __init__(self, n: int, u: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.u, self.width, self.low, self.high, self.samples = n, u, width, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, u = len(v), int(v[-1]) if len(v) else 0
        width = max(0, (u // n).bit_length() - 1) if n else 0
        bits = np.zeros(n * width, np.uint8)
        for b in range(width):
            bits[b::width] = (v >> np.uint64(b)) & np.uint64(1)
        ones = (v >> np.uint64(width)).astype(np.int64) + np.arange(n)
        up = np.zeros(n + (u >> width) + 1, np.uint8)
        up[ones] = 1
        return cls(n, u, width, np.packbits(bits, bitorder="little"), np.packbits(up, bitorder="little"), ones[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        return struct.pack("<QQIII", self.n, self.u, self.width, len(self.samples), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, u, width, k, up = struct.unpack_from("<QQIII", data)
        at = struct.calcsize("<QQIII")
        low = np.frombuffer(data, np.uint8, (n * width + 7) // 8, at)
        high = np.frombuffer(data, np.uint8, up, at + len(low))
        return cls(n, u, width, low, high, np.frombuffer(data, np.uint32, k, at + len(low) + up))

    def select(self, i: int) -> int:
        """The i-th number: from the sample before it, over the upper bits to the i-th one, then its low bits."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        one, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        if left:
            byte = (one + 1) // 8
            bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
            bits[: (one + 1) % 8] = 0
            while left > (c := int(bits.sum())):
                left, byte = left - c, byte + 1
                bits = np.unpackbits(self.high[byte : byte + 1], bitorder="little")
            one = byte * 8 + int(np.flatnonzero(bits)[left - 1])
        value = (one - i) << self.width
        for b in range(self.width):
            k = i * self.width + b
            value |= (int(self.low[k >> 3]) >> (k & 7) & 1) << b
        return value

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.int64) << self.width
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.width]
        for b in range(self.width):
            out |= bits[b :: self.width].astype(np.int64) << b
        return out
