"""Rolling hashes of stretches of bytes or words, and anchors: the least hash of a window."""

from __future__ import annotations

import numpy as np

_FACTOR = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Windows:
    """Hashes of any stretch of a text of bytes or words."""

    def __init__(self):
        self.powers = self.inverse = np.ones(1, np.uint64)

    def load(self, data: bytes) -> None:
        self.load_codes(mixed(np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)))

    def load_codes(self, codes: np.ndarray) -> None:
        n = len(codes)
        if len(self.powers) <= n:
            size = max(n + 1, 1 << 17)
            self.powers, self.inverse = _powers(_FACTOR, size), _powers(pow(_FACTOR, -1, 1 << 64), size)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.powers[:n], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start])

    def segment_hashes(self, first: np.ndarray, last: np.ndarray, spot: np.ndarray, length: int) -> np.ndarray:
        """Of the segments' symbols, the place of their anchor and their number of starts."""
        shape = ((spot - first) * (length + 1) + (last - first)).astype(np.uint64)
        return mixed(self.hashes(first, last + length) ^ mixed(shape + np.uint64(1)))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of every ``width`` consecutive ones: suffix and prefix minima of fixed blocks."""
    n = len(keys)
    padded = np.concatenate([keys, np.full(-n % width, np.uint64(_MASK))]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    count = n - width + 1
    return np.minimum(behind[:count], ahead[width - 1 : width - 1 + count])


def anchor_places(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least hash of every ``width`` consecutive ones, the first of equal ones."""
    place = (1 << 24) - 1
    keys = (h & np.uint64(_MASK ^ place)) | np.arange(len(h), dtype=np.uint64)
    return (_sliding_least(keys, width) & np.uint64(place)).astype(np.int64)
