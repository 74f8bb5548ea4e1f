"""Rolling hashes of byte strings in numpy: the hash of any substring from two prefix sums."""

from __future__ import annotations

import numpy as np


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Base:
    """A random odd base: its powers and those of its inverse modulo 2^64, as far as they were needed."""

    def __init__(self, seed: int) -> None:
        random = np.random.default_rng(seed)
        self.base = int(random.integers(1, 2**63, dtype=np.uint64)) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        #: A random number for each byte, so that strings that differ in few bytes have no chance structure.
        self.table = random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.up = self.down = np.ones(0, dtype=np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, b, dtype=np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up, self.down


class Rolling:
    """Hashes of the substrings of one byte array."""

    def __init__(self, data: np.ndarray, base: Base) -> None:
        up, self.down = base.powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(base.table[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])
