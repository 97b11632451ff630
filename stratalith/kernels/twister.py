"""The 64-bit Mersenne Twister and normal numbers from it, as arrays."""

from __future__ import annotations

import numpy as np

# The generator's published parameters.
N, M = 312, 156
MATRIX = np.uint64(0xB5026F5AA96619E9)
UPPER, LOWER = np.uint64(0xFFFFFFFF80000000), np.uint64(0x7FFFFFFF)
INIT = 6364136223846793005
TEMPERING = ((29, 0x5555555555555555), (-17, 0x71D67FFFEDA60000), (-37, 0xFFF7EEE000000000), (43, 0xFFFFFFFFFFFFFFFF))


class MersenneTwister64:
    def __init__(self, seed: int):
        x = [seed & (2**64 - 1)]
        for k in range(1, N):
            x.append((INIT * (x[-1] ^ (x[-1] >> 62)) + k) & (2**64 - 1))
        self._state = np.array(x, np.uint64)
        self._left = np.zeros(0, np.uint64)

    def _block(self) -> np.ndarray:
        """The next N outputs. The first half depends on old words only, the second on the first."""
        s = self._state
        after = np.roll(s, -1)

        def twist(high: np.ndarray, low: np.ndarray) -> np.ndarray:
            x = (high & UPPER) | (low & LOWER)
            return (x >> np.uint64(1)) ^ np.where(x & np.uint64(1), MATRIX, np.uint64(0))

        new = np.empty_like(s)
        new[:M] = s[M:] ^ twist(s[:M], after[:M])
        after[-1] = new[0]
        new[M:] = new[:M] ^ twist(s[M:], after[M:])
        self._state = new
        out = new.copy()
        for shift, mask in TEMPERING:
            moved = out >> np.uint64(shift) if shift > 0 else out << np.uint64(-shift)
            out ^= moved & np.uint64(mask)
        return out

    def integers(self, n: int) -> np.ndarray:
        parts, have = [self._left], len(self._left)
        while have < n:
            parts.append(self._block())
            have += N
        every = np.concatenate(parts)
        self._left = every[n:]
        return every[:n]

    def uniforms(self, n: int) -> np.ndarray:
        """In (0, 1), by the upper 53 bits."""
        return ((self.integers(n) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


class Normals:
    """Standard normal numbers in pairs; of an odd number asked for, the other half of the last pair is kept."""

    def __init__(self, seed: int):
        self._source, self._spare = MersenneTwister64(seed), np.zeros(0)

    def draw(self, n: int) -> np.ndarray:
        pairs = (n - len(self._spare) + 1) // 2
        u = self._source.uniforms(2 * max(0, pairs)).reshape(-1, 2)
        radius, angle = np.sqrt(-2 * np.log(u[:, 0])), 2 * np.pi * u[:, 1]
        every = np.concatenate([self._spare, np.column_stack([radius * np.cos(angle), radius * np.sin(angle)]).ravel()])
        self._spare = every[n:]
        return every[:n]
