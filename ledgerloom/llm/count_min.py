"""Count-min sketches of 64-bit keys, made in chunks and merged by owners of slices.

A chunk sends the cells that its keys touch, with their counts, to the owners of the
slices that they lie in. An owner merges the parts of its slice and answers which of a
chunk's cells have a count of two or more. The sketch is as large as the input asks
for: it has a slice for each bucket of the exchange, and nobody holds it whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._exchange import Reader, Writer, runs
from ledgerloom.llm._words import U, mix

ROWS = 2
#: Cells of each row for a byte of text: about two for each word.
CELLS = 0.3
#: Cells of a slice of a row.
LEAST_CELLS = 1 << 12
_LOW = U(0xFFFFFFFF)


def slice_cells(n_bytes: int, slices: int) -> int:
    """Cells of a slice of each row for so many bytes of text. A slice follows the size of a chunk, so it stays below 2**32."""
    return max(LEAST_CELLS, int(CELLS * n_bytes / slices))


class Touched:
    """The cells that a chunk's keys touch, ascending by slice and cell in each row."""

    def __init__(self, keys: np.ndarray, slices: int, width: int):
        self.rows = []
        for row in range(ROWS):
            h = mix(keys ^ U(0x9E3779B97F4A7C15 * (row + 1) % (1 << 64)))
            place = (((h >> U(32)) * U(slices) >> U(32)) << U(32)) | ((h & _LOW) * U(width) >> U(32))
            cells, which, counts = np.unique(place, return_inverse=True, return_counts=True)
            self.rows.append((cells & _LOW, which, counts, {k: (a, b) for k, a, b in runs(cells >> U(32))}))

    def parts(self) -> dict[int, bytes]:
        """The part of each slice."""
        out = {}
        for k in sorted(set().union(*(cuts for *_, cuts in self.rows))):
            part, sizes = Writer(), []
            for cells, _, counts, cuts in self.rows:
                a, b = cuts.get(k, (0, 0))
                part.steps(cells[a:b], 4).put(np.minimum(counts[a:b], 255), 1)
                sizes.append(b - a)
            out[k] = part.done(*sizes)
        return out

    def repeated(self, answers: dict[int, bytes]) -> np.ndarray:
        """Whether the sketch takes each key to occur twice or more."""
        out, read = True, {k: np.unpackbits(np.frombuffer(bits, dtype=np.uint8)) for k, bits in answers.items()}
        before = dict.fromkeys(read, 0)
        for cells, which, _, cuts in self.rows:
            flags = np.zeros(len(cells), dtype=bool)
            for k, (a, b) in cuts.items():
                flags[a:b] = read[k][before[k] : before[k] + b - a]
                before[k] += b - a
            out = out & flags[which]
        return out


def merged(parts: list[bytes], width: int) -> list[bytes]:
    """Of the parts of a slice, for each the bits of its cells, row after row: whether two keys or more met there."""
    totals, touched = np.zeros((ROWS, width), dtype=np.uint8), []
    for part in parts:
        read = Reader(part, ROWS)
        cells = []
        for row, n in enumerate(read.sizes):
            cells.append(read.steps(n, 4))
            counts = read.take(n, 1).astype(np.uint16)
            totals[row, cells[-1]] = np.minimum(totals[row, cells[-1]] + counts, 255)
        touched.append(cells)
    return [np.packbits(np.concatenate([totals[row, c] >= 2 for row, c in enumerate(cells)])).tobytes() for cells in touched]


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
