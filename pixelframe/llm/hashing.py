"""Hashes of n-grams and words of many bytes at once, with numpy; arithmetic is modulo 2**64."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the factor and of its inverse. Only tables up to four million entries are kept."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 20)
        made = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, x, np.uint64)))) for x in (_P, _INVERSE)]
        if size <= 1 << 22:
            _powers[:] = made
        return made[0], made[1]
    return _powers[0], _powers[1]


class Spans:
    """Hashes of any spans of a byte array, by prefix sums."""

    def __init__(self, data: np.ndarray):
        self.power, self.inverse = _tables(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(h + np.uint64(salt * 0xA0761D6478BD642F % (1 << 64)))


def words(is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], is_word.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
