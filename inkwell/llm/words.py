"""Hashes of words, for many texts at once."""

from __future__ import annotations

import numpy as np

_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)], np.uint8)
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)


class Powers:
    """Powers of the hash's base and of its inverse, grown as texts need."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << n.bit_length()
            steps = np.full(size, BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
            for s in steps:
                s[0] = 1
            self.up, self.down = (np.cumprod(s) for s in steps)
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and the text it is of. Words are runs of letters, digits and characters beyond ASCII, A-Z lowered."""
    n = len(offsets) - 1
    # A space after each text keeps the last word of one from the first of the next.
    spaced = np.full(len(data) + n, 32, np.uint8)
    spaced[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = _FOLD[data]
    edge = np.diff(np.concatenate([[0], (spaced != 32).view(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _POWERS.to(len(spaced) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(spaced * up[: len(spaced)], dtype=np.uint64)])
    text = np.searchsorted(offsets[:-1] + np.arange(n), begin, side="right") - 1
    return mix((sums[end] - sums[begin]) * down[begin]), text
