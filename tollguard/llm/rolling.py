"""Polynomial hashes of byte ranges, modulo 2^64, for whole buffers at a time."""

from __future__ import annotations

from functools import cache

import numpy as np


def odd_numbers(n: int, seed: int) -> np.ndarray:
    draw = np.random.Generator(np.random.PCG64(seed))
    return draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _fixed() -> tuple[np.ndarray, np.uint64, np.uint64]:
    """A number for each byte, the base of the polynomial, and its inverse."""
    numbers = odd_numbers(257, 4)
    base = numbers[256]
    return numbers[:256], base, np.uint64(pow(int(base), -1, 1 << 64))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = (np.full(size, x) for x in _fixed()[1:])
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any ranges of a buffer, or of the rows of a matrix of bytes."""

    def __init__(self, data: np.ndarray) -> None:
        n = data.shape[-1]
        up, self.down = _powers(1 << max(18, int(n).bit_length()))
        self.total = np.zeros((*data.shape[:-1], n + 1), dtype=np.uint64)
        np.cumsum(_fixed()[0][data] * up[:n], axis=-1, out=self.total[..., 1:])

    def ranges(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        """The hash of each range, equal for equal bytes wherever they stand."""
        return mixed((self.total[..., end] - self.total[..., start]) * self.down[start])
