"""Packing by concatenate and cut.

Pass 1 tokenises each partition once and writes the ids with their place among the
partition's tokens; the partitions' totals, one number each, give by a prefix sum the
global offset of each partition. Pass 2 turns places into global ones and cuts at
multiples of the window: ``pack`` gives the pieces of each document. ``sequences`` gives
the windows themselves: those that lie in one run of ids are whole where they are cut,
and only boundary records, the ends of runs, meet in a shuffle.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from unicodedata import category, is_normalized

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm._shared import small_batches, trimmed, written

WINDOW = 2048
END_ID = 1
#: Distinct words whose ids a worker remembers at once, and the bytes of a word that it remembers.
CACHED_WORDS = 600_000
CACHED_BYTES = 64
#: What a tokenizer has to be like for words to be encoded one by one (fixed values).
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}


class WordTokenizer:
    """Ids of texts.

    A tokenizer that composes, lower-cases and splits as above never joins ids across
    ASCII white space, so each word between such spaces is encoded once and remembered;
    and it starts a new unit at the punctuation that follows a plain letter and lowers
    such letters one by one, so words are encoded without it and in lower case. Any other
    tokenizer encodes whole texts.
    """

    #: Punctuation without apostrophes, which begin contractions, and what added tokens are made of.
    MARKS = b".,;:!?*$&#%@~^_=+-/\\\"()[]{}`"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits each")
        self.by_word = _by_word(json.loads(self.tokenizer.to_str()))
        self.ends_unit = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends_unit[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each word. Words of lower-case letters are encoded side by side in one
        text: where there are as many ends of units as words, each word is one unit."""
        out, side, alone = {}, [], []
        for w in words:
            (side if w.isalpha() and w.islower() or _lower_letters(w) else alone).append(w)
        for k in range(0, len(side), 1000):
            cut = side[k : k + 1000]
            ids = np.array(self._batch([b" ".join(cut)])[0].ids, dtype="<u2")
            ends = np.flatnonzero(self.ends_unit[ids]) + 1
            if len(ends) == len(cut) and ends[-1] == len(ids):
                data, bounds = ids.tobytes(), (2 * ends).tolist()
                out.update(zip(cut, [data[a:b] for a, b in zip([0, *bounds], bounds, strict=False)], strict=True))
            else:
                alone += cut
        out.update(zip(alone, [array("H", e.ids).tobytes() for e in self._batch(alone)], strict=True))
        return out

    def _batch(self, words: list[bytes]) -> list:
        return self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)

    @staticmethod
    def _lowered(word: bytes) -> bytes:
        """A word of plain letters in lower case, any other as it is."""
        if word.isalpha():
            return word.lower()
        text = word.decode("utf-8", "replace")
        return "".join(map(str.lower, text)).encode() if all(map(_plain_letter, text)) else word

    def _learn(self, words: set[bytes]) -> None:
        """Ids of new words: those of what stands before trailing marks, in lower case, and of the marks."""
        known, cut, new, long, marked = self.known, [], set(), [], frozenset(self.MARKS)
        for w in words:
            if w.isalpha() and w.islower():
                new.add(w)
                continue
            core = w.rstrip(self.MARKS) if w[-1] in marked else w
            if not (core and (core[-1:].isalpha() or core[-1] > 127 and _plain_letter(core.decode("utf-8", "replace")[-1]))):
                core = w
            low, marks = self._lowered(core), w[len(core) :]
            cut.append((w, low, marks))
            if low not in known:
                new.add(low)
            if marks and marks not in known:
                new.add(marks)
            if len(w) > CACHED_BYTES:
                long += low, marks
        known.update(self._encode(list(new)))
        known.update([(w, known[low] + known[marks] if marks else known[low]) for w, low, marks in cut])
        for part in long:
            if len(part) > CACHED_BYTES and part not in words:
                known.pop(part, None)

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 16-bit ids of each text."""
        if not self.by_word:
            return [array("H", e.ids).tobytes() for e in self._batch(texts)]
        out = []
        for k in range(0, len(texts), 32):
            # Only ASCII is the same in lower case before it is composed as after.
            split = [(t.lower() if t.isascii() and b"<|" not in t else t).split() for t in texts[k : k + 32]]
            words, known = set().union(*split), self.known
            new = words.difference(known)
            if new:
                # A word may come with its lower case, and with marks.
                if len(known) + 2 * len(new) > CACHED_WORDS:
                    known.clear()
                    new = words
                self._learn(new)
            out += [b"".join([known[w] for w in own]) for own in split]
            for w in [w for w in new if len(w) > CACHED_BYTES]:
                del known[w]
        return out


def _by_word(config: dict) -> bool:
    """Whether ids of words between ASCII white space, one after the other, are those of the text."""
    before, steps = config["normalizer"] or {}, (config["pre_tokenizer"] or {}).get("pretokenizers", [])
    added = [(t["single_word"], t["lstrip"], t["rstrip"], " " in t["content"] or not t["content"].startswith("<|")) for t in config["added_tokens"]]
    return (
        before.get("normalizers") == _NORMALIZERS
        and [s["type"] for s in steps] == ["Split", "ByteLevel"]
        and steps[0] == _SPLIT
        and not steps[1]["add_prefix_space"]
        and not steps[1]["use_regex"]
        and config["post_processor"] is None
        and config["model"].get("end_of_word_suffix") == "</w>"
        and not config["model"].get("dropout")
        and not any(any(t) for t in added)
    )


@lru_cache(maxsize=4096)
def _plain_letter(c: str) -> bool:
    """Of the scripts below U+0500, which every table of letters has, a letter that neither composition nor lower case splits or joins."""
    return c < "\u0500" and category(c)[0] == "L" and len(c.lower()) == 1 and category(c.lower())[0] == "L" and is_normalized("NFC", c + c.lower())


def _lower_letters(word: bytes) -> bool:
    text = word.decode("utf-8", "replace")
    return text.isalpha() and text.lower() == text and is_normalized("NFC", text)


@lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """One for the tasks of a worker."""
    return WordTokenizer(path)


def _tokenised(df: DataFrame, id_col: str, text_col: str, path: str) -> DataFrame:
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type), T.StructField("part", T.IntegerType()), T.StructField("place", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, place, part = _tokenizer(path), np.array([END_ID], dtype="<u2").tobytes(), 0, TaskContext.get().partitionId()
        for batch in batches:
            ids = [x + end for x in encoder.encode([t or b"" for t in batch["text"].to_pylist()])]
            n = [len(x) // 2 for x in ids]
            places = list(accumulate(n, initial=place))
            place = places.pop()
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([part] * len(n), pa.int32()), pa.array(places, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], [id_col, "part", "place", "n", "ids"])
        encoder.known.clear()
        trimmed(None)

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(tokenise, schema)


def _placed(df: DataFrame, tokenizer_path: str, id_col: str, text_col: str):
    """The tokens of all documents, written, and the global offset of each partition, broadcast."""
    small_batches(df.sparkSession)
    table = written(_tokenised(df, id_col, text_col, tokenizer_path), "tokens")
    totals = sorted(table.groupBy("part").agg(F.sum("n")).collect())
    base = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0)))  # noqa: B905
    return table, df.sparkSession.sparkContext.broadcast(base)


def pack(df: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document: id, start (its document's ids before it),
    length, ids_crc32 (of its ids as little-endian unsigned 32-bit numbers), doc_tokens,
    sequence_id, offset and, if asked for, ids (little-endian, unsigned, 16 bits each).

    Each document's ids end with ``END_ID``; a null or empty text is that id alone.
    The stream of all documents is cut every ``window`` ids, so that only the last
    sequence can be short. Repeated rows are packed each on their own; null ids stay
    null. Other columns aren't read. An empty table gives none.
    """
    table, bases = _placed(df, tokenizer_path, id_col, text_col)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.array([bases.value[p] for p in batch["part"].to_pylist()], dtype=np.int64) + batch["place"].to_numpy()
            n, ids = batch["n"].to_numpy(), batch["ids"].to_pylist()
            pieces = (place + n - 1) // window - place // window + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            sequence = place[row] // window + nth
            first = np.maximum(place[row], sequence * window)
            length = np.minimum(place[row] + n[row], (sequence + 1) * window) - first
            start = first - place[row]
            cuts = [ids[r][2 * s : 2 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist(), strict=True)]
            sums = [zlib.crc32(np.frombuffer(x, dtype="<u2").astype("<u4")) for x in cuts]
            columns = [batch[id_col].take(pa.array(row)), *map(pa.array, (start, length)), pa.array(sums, pa.int64()), *map(pa.array, (n[row], sequence, first - sequence * window))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cuts, pa.binary())] if with_ids else columns, schema.names)

    return table.mapInArrow(cut, schema)


def sequences(df: DataFrame, tokenizer_path: str, window: int = WINDOW, pad_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each window of ``pack``: sequence_id, length (without padding), ids
    (little-endian, unsigned, 16 bits each) and pieces (id, offset and length of each
    document in it, in order). With pad_id the ids of a short window, which only the
    last can be, are padded with it. Nulls, repeated rows and empty tables as in
    ``pack``.
    """
    table, bases = _placed(df, tokenizer_path, id_col, text_col)
    piece = T.StructType([T.StructField("id", df.schema[id_col].dataType), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([T.StructField("sequence_id", T.LongType()), T.StructField("first", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("pieces", T.ArrayType(piece))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def out(rows: list[dict]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield from pa.Table.from_pylist(rows, schema=arrow).to_batches()

        now, done = None, []
        for batch in batches:
            starts = np.array([bases.value[p] for p in batch["part"].to_pylist()], dtype=np.int64) + batch["place"].to_numpy()
            for own, start, ids in zip(batch[id_col].to_pylist(), starts.tolist(), batch["ids"].to_pylist(), strict=True):
                at, end = start, start + len(ids) // 2
                while at < end:
                    sequence, offset = divmod(at, window)
                    if now and (now["sequence_id"] != sequence or now["first"] + now["length"] != offset):
                        done.append(now)
                        now = None
                    now = now or {"sequence_id": sequence, "first": offset, "length": 0, "ids": b"", "pieces": []}
                    n = min(end - at, window - offset)
                    now["ids"] += ids[2 * (at - start) : 2 * (at - start + n)]
                    now["length"] += n
                    now["pieces"].append({"id": own, "offset": offset, "length": n})
                    at += n
            yield from out(done)
            done = []
        yield from out([now] if now else [])

    cuts = written(table.mapInArrow(cut, schema), "windows")
    whole = cuts.where(F.col("length") == window).drop("first")
    # Boundary records: the first and last windows of runs, a few a partition.
    parts = F.array_sort(F.collect_list(F.struct("first", "ids", "pieces")))
    joined = F.aggregate(F.transform("p", lambda x: x["ids"]), F.unhex(F.lit("")), lambda a, b: F.concat(a, b))
    ends = cuts.where(F.col("length") < window).groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p"))
    found = whole.unionByName(ends.select("sequence_id", "length", joined.alias("ids"), F.flatten(F.transform("p", lambda x: x["pieces"])).alias("pieces")))
    if pad_id is None:
        return found
    pad = F.unhex(F.lit(pad_id.to_bytes(2, "little").hex()))
    padded = F.concat("ids", F.unhex(F.repeat(F.hex(pad), window - F.col("length").cast("int"))))
    return found.withColumn("ids", F.when(F.col("length") < window, padded).otherwise(F.col("ids")))
