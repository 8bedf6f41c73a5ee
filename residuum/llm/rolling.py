"""Polynomial hashes of any substrings from prefix sums, modulo 2 ** 64."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2 ** 64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


class Rolling:
    """Hashes of the substrings ``[start, end)`` of ``raw``."""

    def __init__(self, raw: bytes):
        buf = np.frombuffer(raw, np.uint8)
        power, self._inverse = _powers(max(1 << 20, 1 << (len(raw) + 1).bit_length()))
        self._total = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=self._total[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._total[ends] - self._total[starts]) * self._inverse[starts])

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all substrings of ``length``, by start."""
        t = self._total
        return mix((t[length:] - t[:-length]) * self._inverse[: max(0, len(t) - length)])
