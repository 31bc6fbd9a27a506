"""Asking owners of keys about keys that chunks of documents hold.

Documents are dealt to chunks by a hash of their id and bytes. A chunk sends each key
bucket one blob of its distinct keys; the bucket answers each chunk with one blob in
the same order; the chunk works out its keys again and reads the answers. A key is
sent once a chunk however often it occurs there, and no group gathers more than a
chunk's texts or a bucket's blobs.

There are as many buckets as chunks, so that blobs sent straight would grow with the
square of the input. Beyond FAN_OUT they travel by way of relays instead: in each step
one digit of the place where they are is replaced by that of the place where they go,
and a relay sends all that has the same next place as one row. A step has at most
FAN_OUT rows for each place, so that rows grow in proportion to places and steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import trimmed

#: Bytes of text of a chunk, on average, from MIN_CHUNKS chunks on.
CHUNK_BYTES = 4 << 20
MIN_CHUNKS = 16
#: Bytes of rows that a task holds to compress those of a chunk together.
PACKED_BYTES = 32 << 20
#: Rows that a place sends in a step, at most.
FAN_OUT = 1024
_ROW = "place int, blobs binary"
_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def chunks_for(n_bytes: int) -> int:
    return max(MIN_CHUNKS, n_bytes // CHUNK_BYTES)


def chunked(df: DataFrame, id_col: str, text_col: str, chunks: int) -> DataFrame:
    """chunk, rows: ids and texts of some of its rows, compressed together."""
    spread = F.pmod(F.xxhash64(F.col(id_col), F.octet_length(text_col), F.substring(F.col(text_col), 1, 64)), F.lit(chunks)).cast("int")
    return packed(df.select(spread.alias("chunk"), F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")))


def packed(rows: DataFrame) -> DataFrame:
    """chunk, rows, from chunk, id, text."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            chunk = table["chunk"].to_numpy()
            order = np.argsort(chunk, kind="stable")
            for k, a, b in runs(chunk[order]):
                own = table.select(["id", "text"]).take(pa.array(order[a:b])).combine_chunks()
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as stream:
                    stream.write_table(own)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["chunk", "rows"])

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.nbytes
            if n > PACKED_BYTES:
                yield from out()
                held, n = [], 0
        if held:
            yield from out()
        held.clear()
        trimmed(None)

    return rows.mapInArrow(parts, "chunk int, rows binary")


def steps_for(places: int) -> tuple[int, int]:
    """How many steps lead from any place to any other, and the base of their digits."""
    steps = 1
    while FAN_OUT**steps < places:
        steps += 1
    base = 1
    while base**steps < places:
        base += 1
    return steps, base


def _joined(sources: Sequence[int], targets: Sequence[int], blobs: list[bytes]) -> bytes:
    head = np.array([sources, targets, [len(b) for b in blobs]], dtype="<i8")
    return len(blobs).to_bytes(8, "little") + head.tobytes() + b"".join(blobs)


def _split(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Sources, targets and blobs of some rows, ascending by target and source."""
    heads, blobs = [], []
    for row in rows:
        n = int.from_bytes(row[:8], "little")
        head = np.frombuffer(row, dtype="<i8", count=3 * n, offset=8).reshape(3, n)
        ends = (8 + 24 * n + np.cumsum(head[2])).tolist()
        blobs += [row[a:b] for a, b in zip([8 + 24 * n, *ends[:-1]], ends, strict=True)]
        heads.append(head[:2])
    sources, targets = np.concatenate(heads, axis=1) if heads else np.zeros((2, 0), dtype=np.int64)
    order = np.lexsort((sources, targets))
    return sources[order], targets[order], [blobs[k] for k in order.tolist()]


def _moved(at: int, step: int, base: int, sources: np.ndarray, targets: np.ndarray, blobs: list[bytes]) -> pa.Table:
    """A row for each next place."""
    unit = base**step
    following = at + ((targets // unit) % base - (at // unit) % base) * unit
    order = np.argsort(following, kind="stable")
    found = runs(following[order])
    rows = [_joined(sources[order[a:b]], targets[order[a:b]], [blobs[k] for k in order[a:b].tolist()]) for _, a, b in found]
    return pa.table({"place": pa.array([k for k, *_ in found], pa.int32()), "blobs": pa.array(rows, pa.binary())})


def _relayed(rows: DataFrame, steps: int, base: int) -> DataFrame:
    """After all steps but the first, which the sender takes."""

    def relay(step: int):
        def moved(table: pa.Table) -> pa.Table:
            return trimmed(_moved(table["place"][0].as_py(), step, base, *_split(table["blobs"].to_pylist())))

        return moved

    for step in range(1, steps):
        rows = rows.groupBy("place").applyInArrow(relay(step), _ROW)
    return rows


#: From ids, texts and the answers of earlier rounds to the blob of each bucket.
Make = Callable[[list, list[bytes], list[dict[int, bytes]]], dict[int, bytes]]


def ask(docs: DataFrame, make: Make, answer: Callable[[list[bytes], int], list[bytes]], places: int, before: Sequence[DataFrame] = ()) -> DataFrame:
    """The answers of a round, for ``ask`` and ``finish``.

    docs: chunk, rows (``chunked``), with chunks from 0 to places - 1, as many as buckets.
    answer: the blobs of a bucket, and its number, to as many answers. before: answers of earlier rounds.
    """
    steps, base = steps_for(places)

    def sent(table: pa.Table, answers: list[dict[int, bytes]]) -> pa.Table:
        chunk = table["chunk"][0].as_py()
        blobs = make(*_sorted(table), answers)
        targets = np.array(list(blobs), dtype=np.int64)
        return trimmed(_moved(chunk, 0, base, np.full(len(blobs), chunk), targets, list(blobs.values())))

    def answered(table: pa.Table) -> pa.Table:
        bucket = table["place"][0].as_py()
        sources, _, blobs = _split(table["blobs"].to_pylist())
        return trimmed(_moved(bucket, 0, base, np.full(len(blobs), bucket), sources, answer(blobs, bucket)))

    there = _relayed(_with_answers(docs, sent, _ROW, before), steps, base)
    return _relayed(there.groupBy("place").applyInArrow(answered, _ROW), steps, base)


def finish(docs: DataFrame, make: Callable[[list, list[bytes], list[dict[int, bytes]]], pa.Table], schema, answers: Sequence[DataFrame]) -> DataFrame:
    """make: ids, texts and the answers of each round to rows of schema."""
    return _with_answers(docs, lambda table, found: trimmed(make(*_sorted(table), found)), schema, answers)


def _with_answers(docs: DataFrame, make: Callable[[pa.Table, list[dict[int, bytes]]], pa.Table], schema, rounds: Sequence[DataFrame]) -> DataFrame:
    if not rounds:
        return docs.groupBy("chunk").applyInArrow(lambda table: make(table, []), schema)

    n = len(rounds)

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=arrow_schema(schema))
        found = []
        for k in range(n):
            own = right.filter(pa.compute.equal(right["round"], k))
            sources, _, blobs = _split(own["blobs"].to_pylist())
            found.append(dict(zip(sources.tolist(), blobs, strict=True)))
        return make(left, found)

    answers = reduce(DataFrame.unionByName, (r.withColumn("round", F.lit(k)) for k, r in enumerate(rounds)))
    return docs.groupBy("chunk").cogroup(answers.groupBy("place")).applyInArrow(joined, schema)


def _sorted(table: pa.Table) -> tuple[list, list[bytes]]:
    """Ids and texts in an order that doesn't depend on how the rows came."""
    parts = [pa.ipc.open_stream(x.as_buffer()).read_all() for x in table["rows"]]
    rows = sorted((r for t in parts for r in zip(t["id"].to_pylist(), t["text"].to_pylist(), strict=True)), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1] or b""))
    return [r[0] for r in rows], [r[1] or b"" for r in rows]


def arrow_schema(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)


def runs(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """bucket, first and end of each run of equal buckets."""
    if not len(bucket):
        return []
    cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(bucket)]
    return [(int(bucket[a]), a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets in the order of the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Writer:
    """Columns of integers as planes of bytes, all first bytes before all second ones: they compress better."""

    def __init__(self):
        self.parts: list[bytes] = []

    def put(self, x: np.ndarray, width: int) -> Writer:
        """The low ``width`` bytes of each."""
        self.parts.append(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
        return self

    def steps(self, x: np.ndarray, width: int, first: int = 0) -> Writer:
        """Of an ascending column the differences, that of the first item to ``first``."""
        x = x.astype(np.int64)
        return self.put(np.diff(x, prepend=np.int64(first)), width)

    def raw(self, data: bytes) -> Writer:
        self.parts.append(data)
        return self

    def done(self, *sizes: int) -> bytes:
        """Compressed, behind the sizes that the reader needs."""
        return np.array(sizes, dtype="<u4").tobytes() + _COMPRESSOR.compress(b"".join(self.parts))


class Reader:
    """Reads what a writer has put, in the same order."""

    def __init__(self, blob: bytes, sizes: int):
        self.sizes = np.frombuffer(blob, dtype="<u4", count=sizes).astype(int).tolist()
        self.data, self.at = _DECOMPRESSOR.decompress(blob[4 * sizes :]), 0

    def take(self, n: int, width: int) -> np.ndarray:
        out = np.zeros((n, 8), dtype=np.uint8)
        out[:, :width] = np.frombuffer(self.data, dtype=np.uint8, count=n * width, offset=self.at).reshape(width, n).T
        self.at += n * width
        return out.view("<u8").ravel()

    def steps(self, n: int, width: int, first: int = 0) -> np.ndarray:
        return np.cumsum(self.take(n, width).astype(np.int64)) + first

    def raw(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]
