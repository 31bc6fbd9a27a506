"""A wavelet matrix over a permutation, and reporting of the points of rectangles, in numpy."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Points (x, y): ``ys`` holds the y of each x, from 0 to below len(ys). A level holds,
    for a bit of y from the highest on, how many zeros stand before each place."""

    def __init__(self, ys: np.ndarray):
        self.bits = max(1, int(len(ys)).bit_length())
        self.zeros, ys = [], ys.astype(np.int64)
        for k in reversed(range(self.bits)):
            one = (ys >> k) & 1 == 1
            counts = np.zeros(len(ys) + 1, dtype=np.int32)
            np.cumsum(~one, out=counts[1:])
            self.zeros.append(counts)
            ys = np.concatenate([ys[~one], ys[one]])

    def report(self, x0: np.ndarray, x1: np.ndarray, y0: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of all rectangles [x0, x1) x [y0, y1) at once: the number of the rectangle and y of each point in it."""
        which = np.flatnonzero((x0 < x1) & (y0 < y1))
        a, b, y = x0[which].astype(np.int64), x1[which].astype(np.int64), np.zeros(len(which), dtype=np.int64)
        for level, k in zip(self.zeros, reversed(range(self.bits)), strict=True):
            a0, b0 = level[a].astype(np.int64), level[b].astype(np.int64)
            n0 = int(level[-1])
            which, y = np.concatenate([which, which]), np.concatenate([y << 1, y << 1 | 1])
            a, b = np.concatenate([a0, n0 + a - a0]), np.concatenate([b0, n0 + b - b0])
            some = (a < b) & ((y + 1) << k > y0[which]) & (y << k < y1[which])
            which, y, a, b = which[some], y[some], a[some], b[some]
        return which, y
