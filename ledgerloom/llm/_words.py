"""Words of whole texts as byte ranges, and their 64-bit fingerprints, in numpy.

A word is a run of bytes other than space and the controls 9 to 13. Lower-casing
touches A-Z only. Nulls are empty texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U = np.uint64
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SEGMENT = 1 << 18


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


class _Powers:
    """Powers of an odd number modulo 2**64, and of its inverse."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            up, down = np.full(size, self.base, dtype=U), np.full(size, self.inverse, dtype=U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        return self.up, self.down


@dataclass
class Hasher:
    """One of a family of independent fingerprints."""

    seed: int

    def __post_init__(self):
        made = np.random.Generator(np.random.PCG64(self.seed))
        self.table = made.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
        odd = [int(x) | 1 for x in made.integers(1 << 40, 1 << 63, 2)]
        self.bytes, self.items = _Powers(odd[0] * 2 % (1 << 64) | 1), _Powers(odd[1] * 2 % (1 << 64) | 1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A fingerprint of each word, worked out over segments of bounded size."""
        out, i = np.empty(len(starts), dtype=U), 0
        while i < len(starts):
            first = int(starts[i])
            j = max(i + 1, int(np.searchsorted(starts, first + _SEGMENT)))
            last = int(ends[j - 1])
            up, down = self.bytes.of(last - first + 1)
            sums = np.empty(last - first + 1, dtype=U)
            sums[0] = 0
            np.cumsum(self.table[data[first:last]] * up[: last - first], out=sums[1:])
            s, e = starts[i:j] - first, ends[i:j] - first
            out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(U))
            i = j
        return out

    def windows(self, items: np.ndarray, n: int) -> np.ndarray:
        """A fingerprint of each n consecutive items."""
        if len(items) < n:
            return np.zeros(0, dtype=U)
        up, down = self.items.of(len(items) + 1)
        sums = np.empty(len(items) + 1, dtype=U)
        sums[0] = 0
        np.cumsum(items * up[: len(items)], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: len(items) - n + 1])


@dataclass
class Words:
    """The words of a list of texts. Those of text d are [first[d], first[d + 1])."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes | None], lower: bool = False) -> Words:
        texts = [t or b"" for t in texts]
        joined = b"\n".join(texts)
        data = np.frombuffer(joined.lower() if lower else joined, dtype=np.uint8)
        inside = np.zeros(len(data) + 2, dtype=np.int8)
        inside[1:-1] = ~_IS_SPACE[data]
        step = np.diff(inside)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        bounds = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
        return cls(data, starts, ends, np.searchsorted(starts, bounds))

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text(self) -> np.ndarray:
        """The index of each word's text."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashed(self, hasher: Hasher) -> np.ndarray:
        return hasher.words(self.data, self.starts, self.ends)


def inside(text_of: np.ndarray, n: int) -> np.ndarray:
    """Of the windows of n items, which lie in one text."""
    return text_of[: len(text_of) - n + 1] == text_of[n - 1 :] if len(text_of) >= n else np.zeros(0, dtype=bool)
