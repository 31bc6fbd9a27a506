"""Elias-Fano sequences and a two-level n-gram trie in memory-mapped files, on numpy."""

from __future__ import annotations

import json
import os

import numpy as np

U = np.uint64


class EliasFano:
    """A non-decreasing sequence of integers: low bits packed, high bits in unary."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.low_bits, self.low, self.high = n, low_bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.arange(len(self.ones)) * 64 - self.ones
        self._low = np.ndarray((max(0, len(low) - 7),), dtype="<u8", buffer=low, strides=(1,))

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        """values below universe, ascending."""
        values, n = values.astype(U), len(values)
        bits = min(48, max(0, (max(1, universe) // max(1, n)).bit_length() - 1))
        low = np.zeros(n * bits // 8 + 9, dtype=np.uint8)
        if n and bits:
            matrix = ((values[:, None] >> np.arange(bits, dtype=U)) & U(1)).astype(np.uint8)
            packed = np.packbits(matrix.ravel(), bitorder="little")
            low[: len(packed)] = packed
        high = values >> U(bits)
        size = int(max(1, universe) >> bits) + n + 2
        unary = np.zeros((size + 63) // 64 * 64, dtype=np.uint8)
        unary[(high + np.arange(n, dtype=U)).astype(np.int64)] = 1
        return cls(n, bits, low, np.packbits(unary, bitorder="little").view("<u8"))

    def _select(self, k: np.ndarray, sums: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Place of the k-th set bit, from 0, of words whose bits before each are sums."""
        at = np.searchsorted(sums, k, side="right") - 1
        word, k = words[at], k - sums[at]
        place = np.zeros(len(k), dtype=np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(word & U((1 << width) - 1)).astype(np.int64)
            right = k >= below
            k = k - np.where(right, below, 0)
            place += np.where(right, width, 0)
            word = np.where(right, word >> U(width), word)
        return at * 64 + place

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th clear bit of the high part; by one pass over it if there are many to find."""
        if len(k) < len(self.high):
            return self._select(k, self.zeros, ~self.high)
        return np.flatnonzero(np.unpackbits(self.high.view(np.uint8), bitorder="little") == 0)[k]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), dtype=U)
        bit = i * self.low_bits
        return (self._low[bit >> 3] >> (bit & 7).astype(U)) & U((1 << self.low_bits) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        high = (self._select(i, self.ones, self.high) - i).astype(U)
        return (high << U(self.low_bits)) | self._lows(i)

    def successor(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each target the index of the first value that isn't less, and whether it is equal."""
        targets = targets.astype(U)
        high = (targets >> U(self.low_bits)).astype(np.int64)
        beyond = high >= int(self.zeros[-1])
        high = np.where(beyond, 0, high)
        first = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - high + 1, 0)
        last = self._zero(high) - high
        wanted = targets & U((1 << self.low_bits) - 1)
        at, end, left = first.copy(), last.copy(), np.flatnonzero(first < last)
        while len(left):  # by halves, among the values of equal high bits
            middle = (at[left] + end[left]) >> 1
            less = self._lows(middle) < wanted[left]
            at[left] = np.where(less, middle + 1, at[left])
            end[left] = np.where(less, end[left], middle)
            left = left[at[left] < end[left]]
        equal = (at < last) & ~beyond
        some = np.flatnonzero(equal)
        equal[some] = self._lows(at[some]) == wanted[some]
        return np.where(beyond, self.n, at), equal

    @property
    def n_bytes(self) -> int:
        return self.low.nbytes + self.high.nbytes


class NgramTrie:
    """Pairs (context, word) with a row of codes each.

    Level 1 holds the contexts, its pointers say where a context's words begin in level
    2. A word is coded by its rank among the words of this trie, relative to its
    context: the level grows by the vocabulary's size from one context to the next, so
    that the whole level is one ascending sequence and a word is found as a successor.
    """

    def __init__(self, parts: dict[str, EliasFano], codes: np.ndarray):
        self.parts, self.codes = parts, codes

    @classmethod
    def of(cls, contexts: np.ndarray, words: np.ndarray, codes: np.ndarray, bits: int) -> NgramTrie:
        """Pairs ascending by context and word, words below 2**bits; codes: a row of 16 bits each for each pair."""
        known, first, which = np.unique(contexts, return_index=True, return_inverse=True)
        vocabulary, rank = np.unique(words, return_inverse=True)
        level = which.astype(np.int64) * len(vocabulary) + rank
        parts = {
            "contexts": EliasFano.of(known, int(known[-1]) + 1 if len(known) else 1),
            "vocabulary": EliasFano.of(vocabulary, int(vocabulary[-1]) + 1 if len(vocabulary) else 1 << bits),
            "pointers": EliasFano.of(np.append(first, len(words)), len(words) + 1),
            "words": EliasFano.of(level, len(known) * len(vocabulary) + 1),
        }
        return cls(parts, np.ascontiguousarray(codes, dtype="<u2"))

    def save(self, folder: str, name: str) -> None:
        for part, sequence in self.parts.items():
            sequence.low.tofile(os.path.join(folder, f"{name}.{part}.low"))
            sequence.high.tofile(os.path.join(folder, f"{name}.{part}.high"))
        self.codes.tofile(os.path.join(folder, f"{name}.codes"))
        with open(os.path.join(folder, f"{name}.json"), "w") as f:
            json.dump({"parts": {part: [sequence.n, sequence.low_bits] for part, sequence in self.parts.items()}, "codes": self.codes.shape}, f)

    @classmethod
    def mapped(cls, folder: str, name: str) -> NgramTrie:
        with open(os.path.join(folder, f"{name}.json")) as f:
            sizes = json.load(f)
        open_ = lambda part, kind: np.memmap(os.path.join(folder, f"{name}.{part}"), dtype=kind, mode="r")
        parts = {part: EliasFano(n, bits, open_(f"{part}.low", np.uint8), open_(f"{part}.high", "<u8")) for part, (n, bits) in sizes["parts"].items()}
        rows, width = sizes["codes"]
        return cls(parts, open_("codes", "<u2").reshape(rows, width) if rows else np.zeros((0, width), dtype="<u2"))

    def find(self, contexts: np.ndarray, of: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in level 2 (-1 for what isn't here) and codes (0) of each pair of the of-th context and a word."""
        context, seen = self.parts["contexts"].successor(contexts)
        own, which = np.unique(words, return_inverse=True)
        rank, known = (x[which] for x in self.parts["vocabulary"].successor(own))
        place, codes = np.full(len(words), -1, dtype=np.int64), np.zeros((len(words), self.codes.shape[1]), dtype="<u2")
        asked = np.flatnonzero(seen[of] & known)
        if len(asked):
            context = context[of[asked]]
            at, found = self.parts["words"].successor(context * self.parts["vocabulary"].n + rank[asked])
            found &= at < self.parts["pointers"][np.arange(1, self.parts["contexts"].n + 1)].astype(np.int64)[context]
            place[asked[found]] = at[found]
            codes[asked[found]] = self.codes[at[found]]
        return place, codes
