"""Rabin-Karp window hashes and winnowing over numpy arrays of characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 6364136223846793005
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Roller:
    """Hashes of all windows of ``k`` characters, modulo 2^64.

    The base is odd, so it has an inverse, and a window's hash is a difference
    of prefix sums times an inverse power: no loop over characters.
    """

    def __init__(self, k: int, capacity: int = 0):
        self.k, self.capacity = k, -1
        self._grow(capacity)

    def _grow(self, n: int) -> None:
        if n > self.capacity:
            self.capacity = n
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def windows(self, codes: np.ndarray) -> np.ndarray:
        """Mixed hash of each window along the last axis; never 0."""
        n = codes.shape[-1]
        if n < self.k:
            return np.zeros((*codes.shape[:-1], 0), np.uint64)
        self._grow(n)
        c = (codes.astype(np.uint64) + _U(0x9E3779B97F4A7C15)) * _U(0xBF58476D1CE4E5B9)
        c ^= c >> _U(31)
        c *= self.up[:n]
        np.cumsum(c, axis=-1, out=c)
        h = c[..., self.k - 1 :].copy()
        h[..., 1:] -= c[..., : n - self.k]
        h *= self.down[: n - self.k + 1]
        h ^= h >> _U(32)
        h *= _U(0x94D049BB133111EB)
        h ^= h >> _U(29)
        return h | _U(1)


def sliding(a: np.ndarray, w: int, op: np.ufunc, fill: int) -> np.ndarray:
    """``op`` over each run of ``w`` neighbours, in two passes over blocks."""
    n = len(a)
    if n < w:
        return a[:0]
    rows = -(-n // w)
    padded = np.full(rows * w, fill, a.dtype)
    padded[:n] = a
    block = padded.reshape(rows, w)
    head = op.accumulate(block, axis=1).ravel()
    tail = op.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(tail[: n - w + 1], head[w - 1 : n])


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnow(roller: Roller, codes: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the window minima of joined texts.

    Every run of ``width`` neighbouring hashes inside one text has its minimum
    selected, all of equal ones. So two texts that share
    ``roller.k + width - 1`` characters share a selected hash in that stretch.
    """
    h = roller.windows(codes)
    if len(h) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = np.cumsum(lengths)
    room = np.repeat(ends, lengths)[: len(h)] - np.arange(len(h))  # characters left in the own text
    h[room < roller.k] = _U(0xFFFFFFFFFFFFFFFF)
    low = sliding(h, width, np.minimum, 0xFFFFFFFFFFFFFFFF)
    low[room[: len(low)] < roller.k + width - 1] = 0
    # Windows that contain i start at i - width + 1 .. i.
    edge = np.zeros(width - 1, np.uint64)
    best = sliding(np.concatenate([edge, low, edge]), width, np.maximum, 0)
    at = np.flatnonzero(h == best)
    return at, h[at]


def slices(texts: list[str], size: int, halo: int) -> Iterator[tuple[int, int, str]]:
    """Texts in order as (index, offset, part); parts longer than ``size`` overlap by ``halo``."""
    for i, t in enumerate(texts):
        if len(t) <= size + halo:
            yield i, 0, t
        else:
            for a in range(0, len(t) - halo, size):
                yield i, a, t[a : a + size + halo]
