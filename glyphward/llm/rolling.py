"""Hashes of word windows with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Words whose hashes a worker remembers.
REMEMBERED = 300_000


class WordHashes(dict):
    """Word (bytes) to its 64-bit hash; forgets all when full."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


class _Powers:
    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            grow = max(n, 2 * len(self.up), 4096)
            self.up, self.down = _powers(_BASE, grow), _powers(_INVERSE, grow)


_POWERS = _Powers()


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each window of ``width`` items: a polynomial modulo 2 ** 64, mixed."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    _POWERS.reach(n)
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _POWERS.up[:n], dtype=np.uint64)])
        return mixed((sums[width:] - sums[:-width]) * _POWERS.down[:n - width + 1])


def leftmost_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the place of its smallest, the first of equal ones."""
    n = len(values) - width + 1
    best, at, span = values, np.arange(len(values)), 1
    while 2 * span <= width:  # doubling: minimum over spans of 1, 2, 4, ...
        left, right = best[:-span], best[span:]
        take = right < left
        best, at, span = np.where(take, right, left), np.where(take, at[span:], at[:-span]), 2 * span
    rest = width - span
    left, right = best[:n], best[rest:rest + n]
    return np.where(right < left, at[rest:rest + n], at[:n])
