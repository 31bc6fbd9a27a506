"""Removing passages that a document with a smaller id has too.

Pass 1 merges count-min sketches of all windows: a chunk of documents sends its parts to
the owners of the sketch's slices and learns which of its windows may be repeated. Pass
2 groups only those: a chunk sends each once, with the smallest id it has there, and
learns whether any other chunk has a smaller one. The sketch only overestimates, so no
repeated window is lost; windows are told apart by 128-bit fingerprints.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerloom.llm import _exchange, count_min
from ledgerloom.llm._shared import small_batches
from ledgerloom.llm._words import Hasher, Words, inside

WORDS = 13
_FIRST, _SECOND = Hasher(101), Hasher(202)
_NO_ID = np.iinfo(np.int64).max


def _windows(texts: list[bytes], n: int) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, first fingerprints of the windows that lie in one text, and where they start."""
    words = Words.of(texts)
    h = _FIRST.windows(words.hashed(_FIRST), n)
    at = np.flatnonzero(inside(words.text, n))
    return words, h[at], at


class _Candidates:
    """Of a chunk's windows those that may be repeated.

    at, own, key: start, id and number of the key of each; h, h2, least: both
    fingerprints of each key and the least id it has here, ascending."""

    def __init__(self, ids: list, texts: list[bytes], n: int, touched, bits: dict[int, bytes]):
        self.words, h, at = _windows(texts, n)
        some = touched(h).repeated(bits) if len(h) else np.zeros(0, dtype=bool)
        h, at = h[some], at[some]
        h2 = _SECOND.windows(self.words.hashed(_SECOND), n)[at] if len(at) else h
        own = np.array([_NO_ID if i is None else i for i in ids], dtype=np.int64)[self.words.text[at]] if len(at) else np.zeros(0, np.int64)
        order = np.lexsort((own, h2, h))
        h, h2, self.own, self.at = h[order], h2[order], own[order], at[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])
        self.key, self.h, self.h2, self.least = np.cumsum(new) - 1, h[new], h2[new], self.own[new]


def _answer(blobs: list[bytes], bucket: int) -> list[bytes]:
    """For the keys of each blob, whether another blob has a smaller id for it."""
    h, h2, least, ends = [], [], [], [0]
    for blob in blobs:
        read = _exchange.Reader(blob, 1)
        n = read.sizes[0]
        h.append(read.steps(n, 8).view(np.uint64))
        h2.append(np.frombuffer(read.raw(8 * n), dtype=np.uint64))
        least.append(read.take(n, 8).view(np.int64))
        ends.append(ends[-1] + n)
    h, h2, least = np.concatenate(h), np.concatenate(h2), np.concatenate(least)
    order = np.lexsort((least, h2, h))
    new = np.ones(len(h), dtype=bool)
    a, b = h[order], h2[order]
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = least[order][new][np.cumsum(new) - 1]
    beaten = np.empty(len(h), dtype=bool)
    beaten[order] = first < least[order]
    return [np.packbits(x).tobytes() for x in np.split(beaten, ends[1:-1])]


def dedup_substrings(df: DataFrame, n: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: id, n_words, n_removed, removed (spans of words, end
    excluded), kept_text (the kept words joined by a space).

    A word goes if a window of n words of its document covers it whose words also
    start a window in a row with a smaller id; all is judged on the input. A null text
    has no words; texts under n words lose none. Rows of the same id don't count
    against each other. Rows with a null id lose to any other id and to no null one.
    Other columns aren't read.
    """
    small_batches(df.sparkSession)
    n_bytes = count_min.text_bytes(df, text_col)
    places = _exchange.chunks_for(n_bytes)
    width = count_min.slice_cells(n_bytes, places)

    def touched(h: np.ndarray) -> count_min.Touched:
        return count_min.Touched(h, places, width)

    def sketch(ids: list, texts: list[bytes], answers: list) -> dict[int, bytes]:
        return touched(_windows(texts, n)[1]).parts()

    def send(ids: list, texts: list[bytes], answers: list[dict[int, bytes]]) -> dict[int, bytes]:
        found = _Candidates(ids, texts, n, touched, answers[0])
        out = {}
        for k, a, b in _exchange.runs(_exchange.buckets_of(found.h, places)):
            out[k] = _exchange.Writer().steps(found.h[a:b].view(np.int64), 8).raw(found.h2[a:b].tobytes()).put(found.least[a:b], 8).done(b - a)
        return out

    def done(ids: list, texts: list[bytes], answers: list[dict[int, bytes]]) -> pa.Table:
        found = _Candidates(ids, texts, n, touched, answers[0])
        words, beaten = found.words, np.zeros(len(found.h), dtype=bool)
        for k, a, b in _exchange.runs(_exchange.buckets_of(found.h, places)):
            beaten[a:b] = np.unpackbits(np.frombuffer(answers[1][k], dtype=np.uint8), count=b - a).astype(bool)
        gone = found.at[beaten[found.key] | (found.own > found.least[found.key])] if len(found.at) else found.at
        steps = np.zeros(len(words) + n + 1, dtype=np.int64)
        np.add.at(steps, gone, 1)
        np.add.at(steps, gone + n, -1)
        removed = np.cumsum(steps)[: len(words)] > 0
        sums = np.concatenate([[0], np.cumsum(removed)])
        lost = sums[words.first[1:]] - sums[words.first[:-1]]
        spans, kept = [], []
        for d, text in enumerate(texts):
            own_words = text.split()
            if lost[d]:
                flags = removed[words.first[d] : words.first[d + 1]]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
                spans.append([{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
                own_words = compress(own_words, (~flags).tolist())
            else:
                spans.append([])
            kept.append(b" ".join(own_words))
        return pa.table([pa.array(ids, id_type), pa.array(words.counts, pa.int64()), pa.array(lost, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary()).cast(pa.string())], schema=_exchange.arrow_schema(schema))

    span = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(span)), T.StructField("kept_text", T.StringType())])
    types = _exchange.arrow_schema(schema)
    id_type, span_type = types.field(0).type, types.field(3).type
    docs = _exchange.chunked(df, id_col, text_col, places)
    repeated = _exchange.ask(docs, sketch, lambda parts, bucket: count_min.merged(parts, width), places)
    return _exchange.finish(docs, done, schema, [repeated, _exchange.ask(docs, send, _answer, places, [repeated])])
